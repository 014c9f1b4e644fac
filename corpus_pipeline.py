"""A training corpus from raw documents, in stages that each keep what the next one works on.

Every stage takes (spark, docs, sf_dir) and works on all of docs; all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relcheck.llm.op02_near_dedup import near_duplicates
from relcheck.llm.op05_best_fit_packing import pack
from relcheck.llm.op06_decontamination import decontaminated
from relcheck.llm.op07_language_id import UNKNOWN, languages, learn
from relcheck.llm.op10_line_dedup import remove_spread_lines
from relcheck.llm.shared import forget, stored

#: A document goes if no language makes up so much of it.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters, or without a main language, go.

    So do null and empty texts. Repeated rows stay or go together; an empty table
    stays empty; columns beside those of documents stay as they are.
    """
    found = languages(docs, learn(docs), keep=tuple(dict.fromkeys([*docs.columns, "text"])))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; documents of nothing else go.

    Null and empty texts stay as they are; n_chars is told anew. Of repeated rows each
    is treated alike; an empty table stays empty; other columns stay as they are.
    """
    clean = remove_spread_lines(docs, columns=tuple(docs.columns))
    clean = clean.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8.

    Of rows that repeat a doc_id and a text one stays; rows that repeat a doc_id with
    another text stay or go together. Null, empty and wordless texts are alike to
    nothing and stay, as do rows without a doc_id. An empty table stays empty; other
    columns stay as they are, of a repeated row those of any one.
    """
    gone = near_duplicates(docs, shingle=5, threshold=80).filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Rows that repeat are few, if any, and only they are dealt out again.
    repeated = stored(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text", F.col("text").isNull())).dropDuplicates(["doc_id", "_text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Repeated rows stay or go together; an empty table
    stays empty, and without benchmark items all stay; columns stay as they are.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in training sequences of 4096 tokens.

    A null or empty text is one token. Each of repeated rows has pieces of its own; an
    empty table gives none; columns beside doc_id and text aren't looked at.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads it any more
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
