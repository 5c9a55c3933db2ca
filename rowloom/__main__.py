"""`python -m rowloom QUERY SF_DIR [OUT]` runs a named query and shows its rows or writes them as Parquet; without arguments, lists the names."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from rowloom.registry import QUERIES


def main(args: list[str]) -> int:
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return 0 if not args else 2
    spark = SparkSession.builder.appName(f"rowloom {args[0]}").getOrCreate()
    out = QUERIES[args[0]](spark, args[1])
    out.write.mode("overwrite").parquet(args[2]) if len(args) == 3 else out.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
