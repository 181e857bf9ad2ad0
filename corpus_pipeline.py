"""A training corpus from raw documents: rules, near duplicates, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as
Parquet in the shared folder before the next one reads it. All but the last return the columns of
documents. SQL cannot express the stages (learned bands, hash covers, a latent space, randomness tests,
seeded prefixes), so ORACLE_SQL is None and the tests hold each against a brute-force version.

Defined results: documents without text fail the quality rules, and so never reach the other stages. Of rows
with one id and of copies the smallest id stays, once; rows without an id stay only where no copy has one, and
once a text. Ties in the mixture go by hash, then id and text. Extra columns of any name are kept; epoch and
n_tokens get an underscore where documents has columns of these names. Empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellarium.llm.common import table, written
from cellarium.llm.decontaminate import decontaminate_stage
from cellarium.llm.fertility import quality_stage
from cellarium.llm.mixing import mixing_stage
from cellarium.llm.secrets import secrets_stage
from cellarium.llm.simhash import dedup_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, with epoch and n_tokens."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
