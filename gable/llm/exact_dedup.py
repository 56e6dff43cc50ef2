"""Exact de-duplication with DataFrame functions only.

Rows are grouped by a 128-bit hash of their text; then the bytes of every row in a group are compared with those of
the row that stays, and groups in which they differ are dealt anew by hash and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.llm.common import fresh, least_row, written


def content_hash(text: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str = "max", hasher: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: ident, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; the smallest ("min") or largest ("max") id of equal texts stays, a null id only where
    all ids of the text are null. Rows that repeat an id (or the null) with the same text count in group_size and are all
    kept or none; rows that repeat an id with different texts are in different groups. An empty table gives an empty
    one; columns other than ident and text are not read.

    Texts are shuffled twice: by a hash of hash and id, to fetch the one that stays of each repeated hash, and by hash, to compare all others
    with it. These joins are sort-merge joins at every size, with one row a key on their right, so Spark can split a hash
    that a third of the rows share.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_h", hasher(F.col("_t")))
    repeated = written(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("n"), best("_id").alias("k")).where("n > 1"))

    key = lambda i: F.xxhash64("_h", i.isNull(), i)
    stays = rows.select("_id", "_t", key(F.col("_id")).alias("_key")).join(repeated.select("_h", key(F.col("k")).alias("_key")).hint("merge"), "_key")
    # rows that repeat the id: any will do, for in a group of different texts others differ from it
    stays = stays.select("_key", "_h", F.col("_t").alias("_kept")).dropDuplicates(["_key", "_h"]).select("_h", "_kept")
    differ = written(rows.select("_h", "_t").join(stays.hint("merge"), "_h").where(F.col("_t") != F.col("_kept")).select("_h")).distinct()

    apart = rows.join(differ.withColumn("_d", F.lit(True)), "_h", "left")
    apart = apart.select("_id", "_h", F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"), F.when(F.col("_d"), F.col("_t")).alias("_x"))
    split = apart.where(F.col("_x").isNotNull()).groupBy("_h", "_x").agg(F.count(F.lit(1)).alias("n"), best("_id").alias("k"))
    whole = repeated.join(differ, "_h", "left_anti").select("_h", F.lit(None).cast("string").alias("_x"), "n", "k")
    sized = split.select("_h", "_x", "n", "k").unionByName(whole)
    sized = sized.select(F.col("_h").alias("_gh"), F.col("_x").alias("_gx"), "n", "k")
    out = apart.join(sized.hint("merge"), (F.col("_h") == F.col("_gh")) & F.col("_x").eqNullSafe(F.col("_gx")), "left")
    kept = F.coalesce("k", "_id")  # null where all ids of the text are
    return out.select(
        F.col("_id").alias(ident),
        kept.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        kept.eqNullSafe(F.col("_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, one for each text, with all their columns.

    Rows are told apart by id (null is one) and text, so a null or repeated id loses no text; of rows that repeat both, the
    one whose columns are least stays.
    """
    stayed, row, least = fresh(docs, "stay", "row", "least")
    key = lambda sha: F.concat_ws(":", F.col(ident).isNull().cast("string"), F.col(ident).cast("string"), sha)
    stay = exact_groups(docs, ident, text, keep).where("kept").select(key(F.col("text_sha256")).alias(stayed)).distinct()
    rows = docs.withColumn(row, key(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    rows = rows.join(stay.hint("merge"), F.col(row) == F.col(stayed), "left_semi")
    return rows.groupBy(row).agg(least_row(docs).alias(least)).select(f"{least}.*")
