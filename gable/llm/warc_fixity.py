"""WARC records and their fixity: Merkle trees over the records of each file, compared between replicas.

Records are hashed and measured where they are read, and their bytes go no further. Leaves are SHA-256 hashes of whole
records; a node hashes the digests of FANOUT neighbouring nodes, in the order of
their offsets, up to one root a file. Two replicas are compared root by root; only the children of mismatching nodes
are looked at, level by level, down to the records that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gable.llm.common import written

#: Records of a file on average, and nodes under a node.
PER_FILE, FANOUT = 1000, 16


def record_bytes(uri: Column, ident: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record; a null uri or payload is empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:gable:"),
        F.coalesce(ident.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def measured(record: Column) -> Column:
    """Length and SHA-256 of a record: all that an audit carries of it."""
    return F.struct(F.octet_length(record).cast("long").alias("size"), F.unhex(F.sha2(record, 256)).alias("digest"))


def placed(rows: DataFrame, carried: list[str], ident: str = "page_id", first: str = "first", per_file: int = PER_FILE) -> DataFrame:
    """(file, seq, ident, offset, first, carried): measured records dealt into files by their digest, in the order of ident, then digest.

    rows: one row a record, with the measure `first` and other measures `carried` with it. A file holds about per_file
    records however many there are. Rows that repeat a record each have a place; they go to one file by the thousand, so
    that neither one id nor one record fills a file. A null ident comes first.
    """
    files = max(1, -(-rows.count() // per_file))
    same = [ident, first, *carried]
    counted = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 1000).cast("int"))))
    start = F.conv(F.substring(F.hex(F.col(first)["digest"]), 1, 8), 16, 10).cast("long")
    dealt = counted.withColumn("file", F.pmod(start + F.col("_part"), F.lit(files)).cast("int")).repartition("file")
    dealt = dealt.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("_n") - F.col("_part") * 1000).cast("int"))))
    order = W.partitionBy("file").orderBy(ident, F.col(first)["digest"])
    end = F.sum(F.col(first)["size"]).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return dealt.select("file", (F.row_number().over(order) - 1).cast("long").alias("seq"), ident, (end - F.col(first)["size"]).alias("offset"), first, *carried)


def archived(pages: DataFrame, ident: str = "page_id", uri: str = "url", payload: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, seq, ident, offset, first, record): pages as whole records, to be written as files; see placed()."""
    record = record_bytes(F.col(uri), F.col(ident), F.col(payload))
    return placed(pages.select(F.col(ident), measured(record).alias("first"), record.alias("record")), ["record"], ident, "first", per_file)


def index_of(rows: DataFrame, measure: str) -> DataFrame:
    """(file, seq, offset, size, digest) of one replica: a row a record that it holds."""
    return rows.where(F.col(measure).isNotNull()).select("file", "seq", "offset", F.col(measure)["size"].alias("size"), F.col(measure)["digest"].alias("digest"))


def tree(index: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """All nodes of the trees of all files up to `levels`: (file, level, node, digest, offset, size); offset and size are the range covered."""
    level = out = index.repartition("file").select("file", F.lit(0).alias("level"), F.col("seq").alias("node"), "digest", "offset", "size")
    for k in range(1, levels + 1):
        up = level.groupBy("file", F.floor(F.col("node") / F.lit(fanout)).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "digest", "size"))).alias("under"), F.min("offset").alias("offset"), F.sum("size").alias("size"))
        hashed = F.unhex(F.sha2(F.encode(F.concat_ws(",", F.transform("under", lambda x: F.concat_ws(":", x["node"].cast("string"), F.hex(x["digest"]), x["size"].cast("string")))), "UTF-8"), 256))
        level = up.select("file", F.lit(k).alias("level"), F.col("up").alias("node"), hashed.alias("digest"), "offset", "size")
        out = out.unionByName(level)
    return written(out)


def levels_for(index: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves so that every file has one root."""
    top, k = index.agg(F.max("seq")).first()[0] or 0, 0
    while top > 0:
        top //= fanout
        k += 1
    return k


def audited(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, seq, offset, length, status, digest, replica_digest) of the records in which two replicas differ.

    Both are tables as index_of() gives them. status is `changed`, `missing` (not in the replica) or `extra` (only in
    it); offset and length are the primary's, or the replica's of an extra record. Equal replicas, also empty ones,
    give no rows. Children are joined to mismatching parents only, so what is read below a root follows the damage.
    """
    levels = max(levels_for(primary, fanout), levels_for(replica, fanout))
    ours, theirs = tree(primary, levels, fanout), tree(replica, levels, fanout)

    def compared(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("digest").alias("other"), F.col("offset").alias("o"), F.col("size").alias("s"))
        both = a.join(b, (F.col("file") == F.col("f")) & (F.col("node") == F.col("n")), "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        return both.select(F.coalesce("file", "f").alias("file"), F.coalesce("node", "n").alias("node"), "digest", "other", F.coalesce("offset", "o").alias("offset"), F.coalesce("size", "s").alias("size"))

    bad = compared(ours.where(F.col("level") == levels), theirs.where(F.col("level") == levels))
    for k in range(levels - 1, -1, -1):
        parents = bad.select("file", F.col("node").alias("up")).distinct()
        under = [t.where(F.col("level") == k).withColumn("up", F.floor(F.col("node") / F.lit(fanout))).join(parents, ["file", "up"], "left_semi") for t in (ours, theirs)]
        bad = compared(*under)
    status = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return bad.select("file", F.col("node").alias("seq"), "offset", F.col("size").alias("length"), status.alias("status"), F.lower(F.hex("digest")).alias("digest"), F.lower(F.hex("other")).alias("replica_digest"))


def parse(data: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """Records of a WARC file: offset, length, header fields, payload. Reads by Content-Length."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(": ", 1) for line in data[at : end - 4].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        out.append((at, end + n + 4 - at, fields, data[end : end + n]))
        at = end + n + 4
    return out


def read_warc(spark, path: str) -> DataFrame:
    """(path, offset, length, uri, payload) of the records of plain WARC files, through Spark's binary file reader."""
    import pyarrow as pa

    from gable.llm.common import map_arrow

    def records(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(p, o, n, f.get("WARC-Target-URI"), body) for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for o, n, f, body in parse(data)]
        cols = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["path", "offset", "length", "uri", "payload"])

    return map_arrow(spark.read.format("binaryFile").load(path).select("path", "content"), records, "path string, offset long, length long, uri string, payload binary")
