"""The corpus operators as queries over the synthetic tables, and SQL for those SQL can express."""

import corpus_pipeline
from rowloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from rowloom.llm.jaccard_join import op6_jaccard_join
from rowloom.llm.language_id import op1_language_id
from rowloom.llm.language_model import op7_language_model
from rowloom.llm.mixing import OP5_SQL, op5_mix_sources
from rowloom.llm.neighbours import op2_neighbours
from rowloom.llm.packing import op10_packing
from rowloom.llm.pii import op9_pii
from rowloom.llm.sharding import op3_sharding
from rowloom.llm.url_filter import op8_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_neighbours": op2_neighbours,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_model": op7_language_model,
    "op8_url_filter": op8_url_filter,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op5_mix_sources": OP5_SQL}
