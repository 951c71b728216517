"""The queries of this subpackage and the SQL that SQL-expressible ones must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .html_text import op6_html
from .language import op5_language
from .mixing import OP2_SQL, op2_mixing
from .packing import op3_packing
from .pfor import op1_token_ids
from .quality import op9_quality
from .text_dedup import op10_text_dedup
from .topk import OP7_SQL, op7_topk
from .toxicity import op4_toxicity
from .vector_dedup import OP8_SQL, op8_vector_dedup



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all stages of ``corpus_pipeline``, the module at the repository's top, over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_html": op6_html,
    "op7_topk": op7_topk,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_quality": op9_quality,
    "op10_text_dedup": op10_text_dedup,
    "pipeline": pipeline,
}
#: The others and the pipeline learn, tokenize or parse, which SQL can't express.
ORACLES: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op7_topk": OP7_SQL,
    "op8_vector_dedup": OP8_SQL,
}
