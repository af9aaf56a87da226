"""The corpus pipeline over ``documents``: quality, language, lines, near duplicates, packing.

``STAGES`` lists the stages, each a function ``(spark, docs, sf_dir) -> DataFrame`` that calls one operator of
``faultline.llm`` and applies its decisions. All but the last return the columns of ``documents``; between stages the rows
are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import langid, linededup, minhash, packing, quality
from faultline.llm.queries import model_path, table
from faultline.plans.runtime import materialize


def _as(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``docs``."""
    return rows.select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read unlike trusted text of their language go.

    Null and empty texts have no perplexity and go; rows that repeat an id are judged each by its text; texts of any length are
    scored whole. Without labels every text with a character stays. An empty table gives an empty table.
    """
    return _as(quality.classify(docs, table(spark, sf_dir, "labels")).where("kn_kept"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go; the others carry the predicted one.

    Dictionaries are cut from the stage's own labelled documents. Null texts, texts without a letter and narrow margins go;
    without labelled documents all go. Repeated rows are judged each; texts of any length are read whole. An empty table
    gives an empty table.
    """
    rows = langid.label(docs, langid.fit(docs)).where(~F.col("rejected"))
    return _as(rows.withColumn("lang", F.col("lang_pred")) if "lang" in docs.columns else rows, docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines said before go, and documents of which nothing is left; ``n_chars`` follows the text.

    Null and empty texts stay as they are. Of rows equal in id and text all keep the same lines. An empty table gives an empty
    table.
    """
    rows = linededup.dedup_lines(docs).where(F.col("text").isNull() | (F.col("ld_removed") == 0) | F.col("text").rlike(r"\S"))
    return _as(rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays; rows without an id stay.

    Null, empty and wordless texts are like nothing and stay; rows that repeat an id stay or go together. An empty table gives
    an empty table.
    """
    gone = minhash.near_duplicates(docs).where("class_id <> doc_id").select("doc_id")
    return _as(docs.join(gone, "doc_id", "left_anti"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows of 2048 tokens. A null or empty text is its end token; an empty table gives no piece."""
    rows = packing.pack(docs, model_path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("line deduplication", line_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The stages train models and hash; SQL cannot express them. tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
