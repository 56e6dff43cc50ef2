"""Lloyd's clustering of whole-number vectors with the dimensions dealt to shards.

Rows are cut into blocks, and the columns of a block into slices of WIDTH dimensions; a task holds one slice of a block
with the centroids' values in those dimensions. It computes exact partial distances; those of a block are added up by
block, which gives the nearest centroid of every row; each shard then sums its own slice by cluster. The vectors are
written once as small whole numbers, so a round moves partial distances, slices and labels in the narrowest type that
holds them. Only centroids (clusters x dimensions) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import by_group, map_arrow, ready, written

#: Dimensions of a shard and rows of a block.
WIDTH, ROWS = 32, 2048
#: Components beyond this could make squared distances overflow 64 bits.
LARGEST = 1 << 27


def narrow(x: np.ndarray) -> bytes:
    """x in the narrowest signed type that holds it, which the first byte names."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    for size in (1, 2, 4, 8):
        if -(1 << 8 * size - 1) <= low and high < 1 << 8 * size - 1:
            return bytes([size]) + x.astype(f"<i{size}").tobytes()
    raise OverflowError


def widened(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, columns)


def _whole(vectors: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have `dims` finite components, and those as whole numbers."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dims)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[good])
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component times {scale} lies beyond {LARGEST}: squared distances would not fit 64 bits")
    return rows[good], x.astype(np.int64)


def blocks(df: DataFrame, ident: str, vector: str, dims: int, scale: float, width: int = WIDTH, most: int = ROWS) -> DataFrame:
    """(block, shard, n, cells, ids): slices of the vectors with exactly `dims` finite components; ids stand with the first slice."""
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, x = _whole(batch.column(1), dims, scale)
            ids = batch.column(0).take(pa.array(rows))
            for a in range(0, len(rows), most):
                part, cuts = x[a : a + most], range(0, dims, width)
                lists = pa.array([ids[a : a + most].to_pylist()] + [None] * (len(cuts) - 1), pa.list_(batch.schema.field(0).type))
                cells = [narrow(part[:, c : c + width]) for c in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array([len(part)] * len(cuts), pa.int32()), pa.array(cells, pa.binary()), lists],
                    ["block", "shard", "n", "cells", "ids"],
                )
                block += 1

    ready(df.sparkSession)
    return written(df.select(F.col(ident), F.col(vector)).mapInArrow(run, f"block bigint, shard int, n int, cells binary, ids array<{kind}>"))


def first_centroids(df: DataFrame, ident: str, vector: str, dims: int, scale: float, k: int, seed: int) -> np.ndarray:
    """The k kept vectors with the smallest SHA-256 of `seed:ident`, in that order; equal hashes go by the vectors' values, null idents count as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    v = F.col("_v")
    good = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(F.sha2(name, 256).alias("_h"), F.col(vector).cast("array<double>").alias("_v")).where(F.coalesce(good, F.lit(False)))
    rows = rows.select("_h", F.transform("_v", lambda x: F.floor(x * scale)).alias("_v"))
    return np.array([r["_v"] for r in rows.orderBy("_h", "_v").limit(k).collect()], np.int64).reshape(-1, dims)


def assigned(table: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(block, labels, distances) of every block: partial squared distances by slice, added up by block, the least of each row."""
    k = len(centroids)

    def partial(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for shard, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            c = centroids[:, shard * width : (shard + 1) * width]
            x = widened(data, c.shape[1])
            out.append(narrow((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["block", "parts"])

    def nearest(group: pa.Table) -> dict[str, list]:
        total = sum(widened(p, k) for p in group["parts"].to_pylist())
        label = total.argmin(axis=1)  # of equals the first
        return {"block": [group["block"][0].as_py()], "labels": [narrow(label)], "distances": [narrow(total[np.arange(len(total)), label])]}

    parts = map_arrow(table.select("block", "shard", "cells"), partial, "block bigint, parts binary")
    return by_group(parts, ["block"], nearest, "block long, labels binary, distances binary")


def moved(table: DataFrame, labels: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Centroids at the floor of the mean of their rows; those without a row stay. Each shard sums its slices by cluster."""
    k = len(centroids)

    def sums(part: pa.RecordBatch) -> pa.RecordBatch:
        shards, clusters, n, values = [], [], [], []
        for shard, data, of in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
            label = widened(of, 1).ravel()
            x = widened(data, centroids[:, shard * width : (shard + 1) * width].shape[1])
            total = np.zeros((k, x.shape[1]), np.int64)
            np.add.at(total, label, x)
            for j in np.unique(label).tolist():
                shards.append(shard)
                clusters.append(j)
                n.append(int((label == j).sum()))
                values.append(total[j].tolist())
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(clusters, pa.int32()), pa.array(n, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["shard", "cluster", "n", "sums"])

    rows = table.select("block", "shard", "cells").join(labels.select("block", "labels").hint("merge"), "block").select("shard", "cells", "labels")
    each = map_arrow(rows, sums, "shard int, cluster int, n bigint, sums array<bigint>")
    cells = each.select("shard", "cluster", "n", F.posexplode("sums").alias("place", "value"))
    out = centroids.copy()
    # clusters x dimensions rows
    for r in cells.groupBy("shard", "cluster", "place").agg(F.sum("value").alias("s"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["shard"] * width + r["place"]] = r["s"] // r["n"]
    return out


def clustered(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(ident, cluster, distance, cluster_inertia, inertia, centroid): every vector after `rounds` rounds and a last assignment.

    Vectors with another number of components, or with a null, NaN or infinite one, have no row. Components become
    floor(scale * x). Ties go to the smaller cluster number; a cluster without rows keeps its centroid. Null and repeated
    idents are rows of their own; fewer than k vectors give as many clusters; an empty table gives an empty one. Components
    beyond 2^27 are an error. Other columns are not read.
    """
    spark = ready(df.sparkSession)
    kind = df.schema[ident].dataType.simpleString()
    centroids = first_centroids(df, ident, vector, dims, scale, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"`{ident}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    table = blocks(df, ident, vector, dims, scale)
    for _ in range(rounds):
        centroids = moved(table, assigned(table, centroids), centroids)
    last = assigned(table, centroids)

    def unpacked(part: pa.RecordBatch) -> pa.RecordBatch:
        label, distance = (np.concatenate([widened(v, 1).ravel() for v in part.column(i).to_pylist()]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([part.column(0).flatten(), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], [ident, "cluster", "distance"])

    joined = table.where("shard = 0").select("block", "ids").join(last.hint("merge"), "block").select("ids", "labels", "distances")
    rows = written(map_arrow(joined, unpacked, f"`{ident}` {kind}, cluster int, distance bigint"))
    found = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(i, found.get(i, 0), sum(found.values()), c.tolist()) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")  # k rows
    return rows.join(F.broadcast(of), "cluster").select(ident, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
