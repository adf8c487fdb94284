"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes what its predecessor kept, written as Parquet. Every stage but the last returns the columns
of ``documents``.

Defined cases: those of the operators. A row with a null id stays in the near-duplicate stage (it cannot be
named as a copy); of equal rows one stays; rows of one id and different texts are told apart; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.llm import jaccard, langid, packing, quality
from oddsloom.llm.queries import importable
from oddsloom.session import apply_engine_conf, materialize

#: Ids up to this number are sent to all tasks (some 40 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents and, in the others, the lines that fail."""
    kept = quality.clean_documents(docs)
    return kept.withColumns({"n_chars": F.length("text").cast("long")}).select(docs.columns)


def _small_batches(spark: SparkSession) -> None:
    """Texts are long, and a batch of them is held several times on its way to a Python worker and in it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same columns under names that no operator adds, and the new name of each."""
    new = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a clear language; a missing language is filled in."""
    _small_batches(spark)
    plain, new = _neutral(docs)
    found = langid.identify(plain, plain, new["doc_id"], new["text"], new["lang"]).filter(langid.accepted())
    filled = found.withColumns({new["lang"]: F.coalesce(new["lang"], "lang_pred")})
    return filled.select(*new.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of five-word shingles at 0.8 or more."""
    _small_batches(spark)
    plain, new = _neutral(docs)
    id_, text = new["doc_id"], new["text"]
    # A row's key: its id and text as one hash of 64 bits, for an id may stand on rows of different texts.
    key = F.when(F.col(id_).isNotNull(), F.xxhash64(F.col(id_).cast("long"), text))
    keyed = plain.withColumns({"row_key": key})
    classes = materialize(jaccard.similarity_classes(keyed, doc_id="row_key", text=text), "classes-of-documents")
    classes = classes.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("component"))

    def ids(found: DataFrame) -> DataFrame:
        found = materialize(found, "document-ids")
        return F.broadcast(found) if found.count() <= BROADCAST_IDS else found

    # Classes of several keys: the smallest key names the class, the smallest id of its rows stays.
    others = classes.filter("row_key != component").distinct()
    members = ids(others.union(others.select("component", "component").distinct()))
    least = (
        keyed.select("row_key", F.col(id_).cast("long").alias("id"))
        .join(members, "row_key")
        .groupBy("component")
        .agg(F.min(F.struct("id", "row_key")).alias("least"))
        .select(F.col("least.row_key").alias("row_key"))
    )
    copies = ids(members.select("row_key").join(ids(least), "row_key", "left_anti"))
    kept = keyed.join(copies, "row_key", "left_anti")
    again = ids(classes.groupBy("row_key").count().filter("count > 1 and row_key is not null").select("row_key"))
    repeated = kept.join(again, "row_key", "left_semi").dropDuplicates([id_, text])
    kept = kept.join(again, "row_key", "left_anti").unionByName(repeated)
    return kept.select(*new.values()).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

# Language identification and tokens are not expressible in SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    apply_engine_conf(spark)
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
