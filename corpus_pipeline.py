"""From raw documents to packed sequences: each stage's result is written and is the next one's input.

Quality rules and language identification reject documents, of near duplicates one document of each
class stays, documents that contain windows of benchmark items go, and what is left is packed.
Null and empty texts fail the quality rules; an empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import decontamination, language_id, near_dedup, packing, quality_rules
from shelfcast.llm.tables import stage, table

POLICY = "v3"
LEAST_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    return quality_rules.ledger(docs, keep=tuple(columns)).where(~quality_rules.rejected_by(POLICY)).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    found = language_id.predict(docs, language_id.fit_on_folds(docs), keep=tuple(columns))
    return found.where((found["lang_pred"] != language_id.UNKNOWN) & (found["score"] >= LEAST_SCORE)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer(), special_as_text=False)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language models, signatures and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
