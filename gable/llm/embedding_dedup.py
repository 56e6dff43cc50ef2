"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import by_group, forest, map_arrow, mix, paired_blocks, written
from gable.llm.components import connected_components

#: Vectors in a block (a group holds at most two blocks), and vectors that a bucket holds by chance.
BLOCK, BUCKET = 512, 256


def tables_for(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits per table so that a bucket holds about BUCKET of `rows` by chance, and tables so that a pair at the threshold is missed with probability `miss` at most.

    Vectors travel once a table, while a bucket costs one product of matrices, so few bits and large buckets are cheap.
    """
    bits = max(4, min(60, math.ceil(math.log2(max(rows, 1) / BUCKET + 1))))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-alike))


def near_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, miss: float = 1e-3, seed: int = 7) -> DataFrame:
    """One row per row of vectors: ident, n_links, component_id, kept.

    Two rows are linked when the cosine of their vectors, in double precision, is at least `threshold`. Null, zero and
    empty vectors, and those with null or non-finite components, link with nothing and stay. Vectors of different
    lengths never link. Equal vectors are collapsed first and counted back by their number, so a vector that a third of
    the rows share is compared once. A pair at the threshold escapes all tables with probability `miss`; above it, less.
    An empty table gives an empty one.

    ident may be of any type that has an order. Rows are told apart by themselves, not by ident: rows that repeat an ident
    with different vectors have links, component and kept of their own, and rows that repeat both count as copies. A null
    ident is no smallest one: component_id is null, and kept true, only where all rows of a component have none.
    """
    v = F.col(vector).cast("array<double>")
    usable = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable &= F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(ident).alias("_id"), F.when(usable, v).alias("_v"))
    classes = rows.where("_v is not null").groupBy("_v").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))  # written once, so the numbers stay
    bits, tables = tables_for(classes.count(), threshold, miss)
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    width = np.dtype("<f4") if single else np.dtype("<f8")  # as wide as the input, compared as double

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("_v")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(lists.offsets))
        starts = np.concatenate([[0], np.cumsum(ends)])
        keys, signs = np.empty((batch.num_rows, tables), np.int64), [b""] * batch.num_rows
        for dim in np.unique(ends):
            at = np.flatnonzero(ends == dim)
            x = np.stack([flat[starts[i] : starts[i + 1]] for i in at])
            planes = np.random.Generator(np.random.PCG64([seed, int(dim)])).standard_normal((int(dim), bits * tables))
            s = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes > 0
            packed = np.packbits(s, axis=1)
            code = (s.reshape(len(at), tables, bits) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))).astype(np.uint64)
            with np.errstate(over="ignore"):
                keys[at] = mix(mix(mix(code) + np.uint64(dim)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, tables + 1, dtype=np.uint64)).view(np.int64)
            for i, p in zip(at, packed):
                signs[i] = p.tobytes()
        return pa.RecordBatch.from_arrays(
            [
                batch.column("rep"),
                batch.column("copies"),
                pa.array([flat[a:b].astype(width).tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                pa.array(signs, pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel())),
            ],
            names=["rep", "copies", "vec", "signs", "keys"],
        )

    signed = map_arrow(classes.select("rep", "copies", "_v"), hashed, "rep long, copies long, vec binary, signs binary, keys array<long>")
    spread = signed.select("rep", "copies", "vec", "signs", F.posexplode("keys").alias("tab", "key"))

    def compared(table: pa.Table) -> dict | None:
        side, lo, hi = table["side"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
        ids, copies, tab = table["rep"].to_numpy(), table["copies"].to_numpy(), table["tab"][0].as_py()
        a = np.flatnonzero(side == lo)
        b = a if lo == hi else np.flatnonzero(side == hi)
        if not len(a) or not len(b):
            return None
        vec = table["vec"].to_pylist()
        x = np.stack([np.frombuffer(q, width) for q in vec]).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        i, j = np.nonzero(x[a] @ x[b].T >= threshold - 1e-9)
        i, j = a[i], b[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        if len(i):
            near = (x[i] * x[j]).sum(axis=1) >= threshold
            i, j = i[near], j[near]
        if len(i) and tab:  # leave a pair that met in an earlier table
            sg = table["signs"].to_pylist()
            used = np.unique(np.concatenate([i, j]))
            code = {k: np.unpackbits(np.frombuffer(sg[k], np.uint8))[: tab * bits].reshape(tab, bits) for k in used}
            new = np.array([not (code[p] == code[q]).all(axis=1).any() for p, q in zip(i, j)], bool)
            i, j = i[new], j[new]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        leaf, root = forest(ids[i], ids[j])
        at = np.flatnonzero(links)
        return {"a": [*ids[at].tolist(), *leaf.tolist()], "b": [*ids[at].tolist(), *root.tolist()], "n": [*links[at].astype(int).tolist(), *[0] * len(leaf)]}

    blocks = paired_blocks(spread, "key", "rep", F.lit(1), BLOCK)
    found = written(by_group(blocks, ["key", "lo", "hi"], compared, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = connected_components(found.where("n = 0"))
    known = classes.join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select(F.col("_v").alias("_c"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), "least", "component")
    lead = known.where("component is not null").groupBy(F.col("component").alias("_component")).agg(F.min("least").alias("k"))
    known = known.join(lead, F.col("component") == F.col("_component"), "left").select("_c", "n", F.coalesce("k", "least").alias("k"))
    out = rows.join(known, F.col("_v") == F.col("_c"), "left")
    return out.select(
        F.col("_id").alias(ident),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("k", "_id").alias("component_id"),
        F.coalesce("k", "_id").eqNullSafe(F.col("_id")).alias("kept"),
    )
