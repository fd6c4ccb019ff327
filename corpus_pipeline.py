"""The corpus pipeline: stages that clean the documents table and pack it, each written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import materialize, table
from vellum.llm.decontaminate import decontamination_stage
from vellum.llm.langid import language_stage
from vellum.llm.packing import packing_stage
from vellum.llm.pii import pii_stage
from vellum.llm.simhash import near_duplicate_stage

#: (name, function of spark, documents and the folder of the tables). All but the last return the columns of documents.
STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Compression, fingerprints and tokenizers can't be told in SQL; tests/llm/test_pipeline.py checks run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that every stage keeps, packed. A stage reads what the one before it wrote, which is deleted once its own rows are."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), replaces=(docs,))
    return docs
