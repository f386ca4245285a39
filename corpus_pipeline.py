"""The corpus pipeline: toxic documents go, then near copies, repeated byte strings and contaminated documents; what is left is mixed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
``documents``; the last returns how many words the mix takes of each remaining document.

Documents with null ids, texts or other columns pass through: a null or empty text is not toxic, near no other, holds no benchmark
item, and gives the mix no words. Equal rows are copies of each other. Columns beyond those of ``documents`` are kept whatever
their names, long texts are read in parts, and an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import decontamination, mixing, near_dedup, suffix_dedup, toxicity
from quarrylens.llm.scratch import saved, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash near-dedup", near_dedup.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing", mixing.stage),
]

#: the classifier of the first stage can't be expressed in SQL; tests hold the whole against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k}")
    return docs
