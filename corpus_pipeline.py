"""A corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Each stage takes the documents that the stage before it wrote, and returns them filtered or changed; the last one
returns the pieces of packed sequences. Nothing is capped or sampled but the classifier's labelled rows.

All stages but the last keep the columns of documents, whatever their names, with their types; an empty table gives an
empty table. Rows with equal contents are judged alike, rows of one doc_id with different texts each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import jaccard, packing, quality, rules, substring
from calibra.llm.common import bounded, table, written
from calibra.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules keep. Null and empty texts, and all of fewer than 50 words, go; long texts are judged whole."""
    bounded(spark)  # from here on, for all stages
    return rules.filtered(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score as well as THRESHOLD or better; fitted on labels that aren't held out, over all documents.

    Null and empty texts score as the model's offset does; a score of exactly THRESHOLD stays.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    model = spark.sparkContext.broadcast(quality.fit(table(spark, sf_dir, "documents"), labels))  # DIMS weights
    return quality.filtered(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8): that of least doc_id, one without doc_id only if
    all are. Null texts and texts without words all stay; of equal rows one stays."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document of lesser doc_id has out of texts; what is left without a word goes.

    n_chars, where there is such a column, follows the text. Rows without doc_id stay as they are, if they have a word.
    """
    left = substring.without_spans(docs, substring.spans(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens. Null and empty texts are pieces of one token; each row is packed."""
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: SQL can express neither the fitted classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, over=before)
        before = [docs]
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
