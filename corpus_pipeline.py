"""A training corpus from raw documents, in five stages.

Each stage works on what its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents``:

1. language  documents whose language can't be told go; all stay where no row
             is labelled, as there is nothing to tell it from
2. dedup     one document of each group of near duplicates stays (5-word
             shingles, similarity 0.8 or more)
3. secrets   spans that look like secrets are masked
4. mix       sources are sampled to their target weights; a document taken
             twice has two rows
5. pack      documents become pieces in sequences of 1024 tokens

Defined results: columns of ``documents`` beyond the usual ones stay, whatever
their names; the second and fourth stage decide by row, so rows that repeat
a doc_id or have none count by their own texts; texts without words are near
duplicates of nothing; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavault.llm import best_fit_packing, language_id, minhash_dedup, secret_scan, source_mixing
from stratavault.llm.common import materialize, table

#: No single SQL statement expresses the stages; tests hold them against plain Python.
ORACLE_SQL = None

#: A document below this cosine to its nearest language is rejected.  Of sf0.1's
#: 10,000 labelled rows the lowest has 0.03; texts that share no trigram with a
#: language differ from 0 by 1 / sqrt(DIMENSIONS) = 0.004 (standard deviation).
LEAST_SCORE = 0.02
DIMENSIONS = 1 << 16


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"{name}_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that resemble a language of the training rows."""
    model = language_id.train(docs, dimensions=DIMENSIONS)
    if not model.languages:
        return docs
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = language_id.predict(docs, model, docs.columns, (lang, score))
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def rows_of(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """``docs`` with a number that tells rows apart, the name of its column, and
    whether it is doc_id.  Where doc_id repeats or is null, rows are numbered and
    written, so that all later reads see the same numbers."""
    row = fresh(docs, "row")
    each = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    most = each.agg(F.max(F.when(F.col("doc_id").isNull(), F.lit(2)).otherwise(F.col("n")))).first()[0]
    if (most or 0) <= 1:
        return docs.withColumn(row, F.col("doc_id").cast("long")), row, True
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row, False


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near duplicates, the one of the smallest doc_id (null last)."""
    rows, row, own = rows_of(docs)
    classes = minhash_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    if own:
        kept = classes.where("kept").select(F.col("doc_id").alias(row))
    else:
        order = F.struct(F.col("id").isNull(), F.col("id"), F.col("number"))
        named = classes.select(F.col("doc_id").alias("number"), "component_id").join(rows.select(F.col(row).alias("number"), F.col("doc_id").alias("id")), "number")
        kept = named.groupBy("component_id").agg(F.min_by("number", order).alias(row)).select(row)
    return rows.join(materialize(kept, "pipeline-kept"), row, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in every text."""
    return secret_scan.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the mix of their source says."""
    rows, row, _ = rows_of(docs)
    mixed = source_mixing.mix_sources(rows.select(F.col(row).alias("doc_id"), "text", "source"))
    copies = fresh(rows, "copies")
    out = rows.join(mixed.where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(copies)), row)
    return out.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences."""
    return best_fit_packing.pack(best_fit_packing.cut_pieces(docs))


STAGES = [("language", language), ("dedup", dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
