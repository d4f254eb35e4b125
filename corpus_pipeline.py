"""A corpus from documents to packed sequences, in stages that are written one by one.

``run`` writes each stage as Parquet into the shared folder and rereads it, so a
lost executor never repeats more than one stage; what a stage has read is deleted
when it is written. Every stage but the last returns the columns of ``documents``.

Defined results: rows without id are never near copies or repeats of others, and
stay. Null texts stay null and empty ones empty wherever the classifier keeps
them. Repeated rows are one document from the join on. Empty tables give empty
tables, and other columns are passed on as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import dedup, forest, packing, pii, qda
from keelson.llm.common import checked_broadcast, cut, remove, shared_dir, table
from keelson.llm.queries import PII_KEY

#: No SQL: the classifier and the surrogates cannot be expressed in it.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quadratic discriminant rejects; null and empty texts are judged as empty ones."""
    return qda.keep_good(docs, qda.train(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies one row: of the smallest doc_id, and of its texts that with the smallest hash.

    Rows are told apart by doc_id and text; of rows that agree in both one stays.
    Rows without id and texts without a word are in no class and stay.
    """
    rows = cut(forest.jaccard_rows(docs).where("class_key is not null").groupBy("doc_id", "h", "class_key").count())
    first = rows.groupBy("class_key").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    gone = rows.join(first, "class_key").where("struct(doc_id, h) <> first").select("doc_id", "h")
    key, h = (next(n for n in (f"{name}{'_' * k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("key", "text_hash"))
    hashed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64(F.col("text").cast("string")))

    def without(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(checked_broadcast(keys.select(F.col("doc_id").alias(key), F.col("h").alias(h))), [key, h], how)

    kept = without(hashed, gone, "left_anti")
    again = rows.where("count > 1").select("doc_id", "h")
    if not again.isEmpty():
        kept = without(kept, again, "left_anti").unionByName(without(kept, again, "left_semi").dropDuplicates([key, h]))
    return kept.select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; what is left of characters at the cuts goes too.

    Rows without text have none to cut and stay as they are.
    """
    cut_docs = dedup.remove_repeats(_renamed(docs).where("text is not null"), keep_others=True, whole_chars=True)
    return _with_text(cut_docs, docs, F.col("kept").cast("string")).unionByName(docs.where("text is null"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; a null text stays null."""
    return _with_text(pii.pseudonymise(_renamed(docs), PII_KEY, keep_others=True), docs, F.col("text"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences; null and empty texts have no place, but a row."""
    return packing.pack(docs)


def _renamed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns under numbers, which no column of an operator has."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"column {i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))


def _with_text(found: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from renamed ones, with another text and its number of characters."""
    out = []
    for i, c in enumerate(docs.columns):
        if c == "doc_id":
            col = F.col(c)
        elif c == "text":
            col = text
        else:
            col = F.col(f"`column {i}`")
            if c == "n_chars":
                col = F.coalesce(F.char_length(text).cast(docs.schema[c].dataType), col)
        out.append(col.alias(c))
    return found.select(*out)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("pii_surrogates", surrogates),
    ("best_fit_packing", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
