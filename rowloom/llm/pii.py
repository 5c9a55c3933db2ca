"""Personal data: regular expressions propose spans, checksums confirm, nearby words adjust scores.

Base kinds are email, ip, card and phone; the method adds iban (mod 97) and ssn (kept only where
nearby words raise its score). DataFrame functions only. Positions follow from splitting a text at a
pattern: the lengths of pieces and matches add up to starts and ends, in code points.

Patterns are the plain ones with possessive quantifiers and a test that a run of characters is
entered at its start (or where the last match ended, \\G): they match the same spans, in linear time and
without recursion, also on very long texts.

Cases: null and empty texts have no spans; repeated rows give equal rows; a null id is kept as it
is; an empty table gives an empty result. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import table

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",  # its head; mod 97 chooses the end
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this can't hold the kind.
NEEDED = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
KINDS = tuple(PATTERNS)
BASE = KINDS[:4]
#: Length of an IBAN by country. Where the country isn't listed, each end that passes mod 97 will do, the last one first.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
#: Words near a span (within WINDOW code points before or after it, whatever other spans lie there) that raise its score.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
WINDOW, BONUS, LEAST = 40, 0.3, 0.5
#: Numbers whose running sums are made at once.
CHUNK = 256
_SPAN = "array<struct<start:int,end:int,score:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is made once however often body, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def passes(each: Column) -> Column:
        n = F.size(each)

        def term(i: Column) -> Column:
            d = F.get(each, i).cast("int")
            twice = d * 2 - F.when(d > 4, 9).otherwise(0)
            return F.when((n - i) % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + term(i)) % 10 == 0

    return let(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), passes)


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes the mod-97 check, digit by digit."""
    s = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    """Whether the match m of a kind passes its validator."""
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
        return m.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")
    if kind == "card":
        return F.when(F.length(m) < 14, False).otherwise(let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def iban_tail(head: Column, rest: Column) -> Column:
    """What follows head in rest, the text after it, as far as the IBAN goes; null where there is none. Groups of four
    may have a space before them; every end that is no part of a longer word is tried, 34 characters at most."""
    def upto(n: int) -> Column:
        last = rf"(?:\x20?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
        return F.regexp_extract(rest, rf"\A(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{last}(?![A-Za-z0-9])", 0)

    country, says = F.left(head, F.lit(2)), F.lit(None).cast("int")
    for n, names in IBAN_LENGTHS.items():
        says = F.when(country.isin(*names.split()), n).otherwise(says)
    ends = [F.when(F.coalesce(says, F.lit(n)) == n, upto(n)).otherwise("") for n in range(34, 14, -1)]
    return F.get(F.filter(F.array(*ends), lambda t: (t != "") & mod97(F.concat(head, t))), F.lit(0))


def running(lengths: Column) -> Column:
    """The running sums of an array of numbers: first of each CHUNK, then inside of each, so that no list of all sums is copied for every one of them."""
    count = F.size(lengths)
    chunk = lambda i: F.slice(lengths, i * CHUNK + 1, CHUNK)
    empty = F.array().cast("array<int>")

    def sums(numbers: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), empty.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(numbers, zero, step, lambda acc: acc["out"])

    chunks = F.sequence(F.lit(0), F.floor((count - 1) / F.lit(CHUNK)).cast("int"))
    totals = F.transform(chunks, lambda i: F.aggregate(chunk(i), F.lit(0), lambda s, x: s + x))
    parts = let(sums(totals, F.lit(0)), lambda upto: F.transform(chunks, lambda i: sums(chunk(i), F.when(i > 0, F.get(upto, i - 1)).otherwise(0))))
    return F.when(count > 0, F.flatten(parts)).otherwise(empty)


def _before(gaps: Column, hits: Column, i: Column) -> Column:
    """The WINDOW code points before match i, across earlier matches: of each piece no more than that is looked at, and there are two at least in a gap with its match."""
    some = F.lit(WINDOW)
    gap = F.get(gaps, i)
    first = F.greatest(i - WINDOW, F.lit(0))
    pieces = F.zip_with(F.slice(gaps, first + 1, i - first), F.slice(hits, first + 1, i - first), lambda g, h: F.concat(F.right(g, some), F.right(h, some)))
    return F.when((F.length(gap) >= WINDOW) | (i == 0), F.right(gap, some)).otherwise(F.right(F.concat(F.array_join(pieces, ""), gap), some))


def _ahead(gaps: Column, hits: Column, i: Column, most: int) -> Column:
    """The most (at least) code points after match i, across later matches, or all there are."""
    piece = lambda g, h: F.concat(F.left(g, F.lit(most)), F.coalesce(F.left(h, F.lit(most)), F.lit("")))
    gap = F.get(gaps, i + 1)
    across = F.array_join(F.zip_with(F.slice(gaps, i + 2, F.lit(most // 2 + 1)), F.slice(hits, i + 2, F.lit(most // 2 + 1)), piece), "")
    return F.when((F.length(gap) >= most) | (i == F.size(hits) - 1), F.left(gap, F.lit(most))).otherwise(across)


def kind_spans(kind: str, text: Column) -> Column:
    """array<struct<start, end, score>> of a kind's confirmed spans in text."""
    pattern = F.lit(PATTERNS[kind])
    word = rf"(?<![a-z])(?:{CONTEXT[kind]})"
    none = F.array().cast(_SPAN)

    def scored(start: Column, end: Column, before: Column, after: Column) -> Column:
        near = F.lower(before).rlike(word) | F.lower(F.left(after, F.lit(WINDOW))).rlike(word)
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, BONUS).otherwise(0.0))
        return F.struct(start.alias("start"), end.alias("end"), score.alias("score"))

    def spans(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

        def each(ends: Column) -> Column:
            def one(i: Column) -> Column:
                m, end = F.get(hits, i), F.get(ends, i)
                start = end - F.length(m)
                if kind == "iban":
                    # the end follows from the text after the head
                    after = lambda rest, tail: scored(start, end + F.length(tail), _before(gaps, hits, i), F.substr(rest, F.length(tail) + 1))
                    return let(_ahead(gaps, hits, i, 2 * WINDOW), lambda rest: let(iban_tail(m, rest), lambda tail: F.when(tail.isNotNull(), after(rest, tail))))
                return F.when(confirmed(kind, m), scored(start, end, _before(gaps, hits, i), _ahead(gaps, hits, i, WINDOW)))

            return F.transform(F.sequence(F.lit(0), F.size(hits) - 1), one)

        return F.when(F.size(hits) > 0, F.filter(let(running(lengths), each), lambda s: s.isNotNull() & (F.lit(kind in BASE) | (s["score"] >= LEAST)))).otherwise(none)

    found = let(F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")), spans)
    if kind == "iban":
        # a group inside an IBAN may look like a head
        free = lambda acc, s: (F.size(acc) == 0) | (s["start"] >= F.try_element_at(acc, F.lit(-1))["end"])
        found = F.aggregate(found, none, lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    possible = text.contains(NEEDED[kind]) if kind in NEEDED else F.lit(True)
    return F.coalesce(F.when(possible, found), none)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """id and one array column of spans (start, end, score) per kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), *[kind_spans(k, text).alias(k) for k in kinds])


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    def entries(n: int, kind: str) -> Column:
        def entry(s: Column) -> Column:
            says = F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
            return F.struct(s["start"].alias("start"), F.lit(n).alias("n"), says.alias("says"))

        return F.transform(kind, entry)

    rows = [entries(n, k) for n, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda s: s["says"]), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(table(spark, sf_dir, "documents"))
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE).cast("binary"), 256).alias("base_sha256"), listed(KINDS).alias("spans"),
    )
