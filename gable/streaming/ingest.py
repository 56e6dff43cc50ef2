"""Incremental ingestion of listings as a stream.

Beside the stored table lies a Bloom filter of its ids, in blocks of 64 bits: a row (cell, bits) a block that is not
empty. A batch asks the filter first. Rows whose id it has never seen are new without a look at the table; only the
others, repeats and a few mistaken for them, are held against the stored ids, and only in the buckets that they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of the stored table.
BUCKETS = 64
#: Ids for which the filter is laid out, bits an id, and bits set in a block by one id: about one id in 200 is mistaken when it is full.
EXPECTED, BITS_EACH, MARKS = 16_000_000, 16, 5


def bucket_of(ident: str) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(BUCKETS)).cast("int")


def block(ident: str, expected: int) -> list[Column]:
    """Cell and mask of an id, by two hashes: MARKS bits of one block, so an id is asked for with one look-up."""
    cells = max(1, expected * BITS_EACH // 64)
    h = F.xxhash64(F.lit("mask"), F.col(ident))
    mask = F.lit(0).cast("long")
    for i in range(MARKS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    return [F.pmod(F.xxhash64(F.lit("cell"), F.col(ident)), F.lit(cells)).alias("cell"), mask.alias("mask")]


class SeenIds:
    """The filter of a table's ids, in numbered versions; the last whole one counts.

    A version has at most EXPECTED * BITS_EACH / 64 rows, however large the table. With more ids than expected more rows
    go to the table to be asked for there; none is lost or doubled. A filter laid out for another number of ids is made
    anew from the table, as is one that is not there.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = EXPECTED):
        self.spark, self.expected = spark, expected
        self.path, self.name = path, f"for={expected}"
        self.root = f"{path}/{self.name}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def versions(self) -> list[int]:
        """Numbers of the versions that were written to their end, ascending."""
        found = self._fs.listStatus(self._path(self.root)) if self.exists(self.root) else []
        numbers = [int(x.getPath().getName()[1:]) for x in found]
        return sorted(n for n in numbers if self.exists(f"{self.root}/v{n}/_SUCCESS"))

    def current(self) -> DataFrame | None:
        have = self.versions()
        return self.spark.read.schema("cell long, bits long").parquet(f"{self.root}/v{have[-1]}") if have else None

    def add(self, ids: DataFrame, ident: str) -> None:
        """A new version with the ids in it; versions before the last one go, and filters of another layout."""
        new = ids.select(*block(ident, self.expected)).groupBy("cell").agg(F.bit_or("mask").alias("bits"))
        old, have = self.current(), self.versions()
        for x in self._fs.listStatus(self._path(self.path)) if self.exists(self.path) else []:
            if x.getPath().getName() != self.name:  # of another layout: it would miss these ids
                self._fs.delete(x.getPath(), True)
        if old is not None:
            new = old.unionByName(new).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
        new.write.mode("overwrite").parquet(f"{self.root}/v{(have or [0])[-1] + 1}")
        for n in have[:-1]:
            self._fs.delete(self._path(f"{self.root}/v{n}"), True)

    def asked(self, batch: DataFrame, ident: str) -> DataFrame:
        """batch with `maybe`: whether its id may have been seen; false is certain. A null id may always have been."""
        bits = self.current()
        if bits is None:
            return batch.withColumn("maybe", F.lit(False))
        cell, mask = block(ident, self.expected)
        held = bits.select(F.col("cell").alias("_cell"), F.col("bits").alias("_bits"))
        hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
        return batch.withColumns({"_of": cell, "_mask": mask}).join(held, F.col("_of") == F.col("_cell"), "left").select(*batch.columns, (hit | F.col(ident).isNull()).alias("maybe"))


def append_unseen(batch: DataFrame, target: str, ident: str = "id", expected: int = EXPECTED) -> list[int]:
    """Append the rows of batch whose id is not in the table at `target`, one row an id; returns the buckets of the table it had to read.

    The filter is written before the rows: a batch that is lost in between and comes again is then taken for seen, held
    against the table and appended, so a replay adds what is missing and nothing twice. A null id is an id like any
    other: one row of it is kept.
    """
    spark = batch.sparkSession
    seen = SeenIds(spark, f"{target.rstrip('/')}.seen", expected)
    batch = batch.withColumn("bucket", bucket_of(ident)).dropDuplicates([ident])
    stored = spark.read.schema(batch.schema).parquet(target) if seen.exists(target) else None
    if stored is not None and not seen.versions():
        seen.add(stored, ident)
    asked = seen.asked(batch, ident).persist()
    touched = sorted(r["bucket"] for r in asked.where("maybe").select("bucket").distinct().collect())  # BUCKETS at most
    come = asked.drop("maybe")
    if stored is not None and touched:
        known = stored.where(F.col("bucket").isin(touched)).select(F.col(ident).alias("_id"), F.col("bucket").alias("_at"))
        maybe = asked.where("maybe").drop("maybe").join(known, (F.col("bucket") == F.col("_at")) & F.col(ident).eqNullSafe(F.col("_id")), "left_anti")
        come = asked.where("not maybe").drop("maybe").unionByName(maybe)
    seen.add(asked, ident)
    come.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(target)
    asked.unpersist()
    return touched if stored is not None else []


def ingest(stream: DataFrame, target: str, checkpoint: str, ident: str = "id", time: str = "ts", late: str = "10 minutes", expected: int = EXPECTED):
    """Append unseen ids of a stream to the Parquet table at `target`; returns the started query.

    State is bounded by the watermark: dropDuplicatesWithinWatermark drops repeats within it, and each batch is held
    against the filter of stored ids and, where that says maybe, against the stored table, so repeats that come later are
    dropped too. The table is partitioned by a bucket of the id (column `bucket`); the filter lies beside it (`.seen`).
    """
    unique = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])

    def append(batch: DataFrame, number: int) -> None:
        append_unseen(batch, target, ident, expected)

    return unique.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
