"""Training-data pipeline over ``documents``: each stage works on what the one
before it kept, written as Parquet and read again.

toxicity       documents that the classifier rejects go
line_dedup     repeated line chunks go, the documents stay
near_dedup     one document of each group of near duplicates stays
decontaminate  documents that hold benchmark text go
mixing         every document gets its domain and sampling rate
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.decontaminate import decontaminate_stage
from quire.llm.frames import documents, stored
from quire.llm.line_dedup import line_dedup_stage
from quire.llm.mixing import mixing_stage
from quire.llm.near_dedup import near_dedup_stage
from quire.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: Trained and hashed stages have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the rows of the last one."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
