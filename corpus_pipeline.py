"""The documents' way to training sequences: each stage's result is written as Parquet and read by the next.

Toxic documents go; of each group of near duplicates one stays; documents that
hold passages of the benchmark go; personal data give way to their kinds in
brackets; what is left is packed into sequences.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import decontaminate, jobs, neardup, packing, pii, toxicity

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("near_duplicates", neardup.keep_one),
    ("decontamination", decontaminate.drop_contaminated),
    ("personal_data", pii.redact),
    ("packing", packing.pack_stage),
]
#: SQL can express neither the scores of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences' pieces of the documents table in sf_dir."""
    docs = jobs.read(spark, sf_dir, "documents")
    to = f"{jobs.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{to}/{name}")
        docs = spark.read.parquet(f"{to}/{name}")
    return docs
