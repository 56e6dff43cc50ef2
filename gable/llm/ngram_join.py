"""Near-copy documents by the Jaccard similarity of their word shingles, with Bayesian pruning of candidates.

Texts with the same shingles form a class. Classes that share a band of MinHash values are candidates; those that
candidates connect are brought together (whole texts, in bounded pairs of blocks), where each pair's MinHash values
are compared a few at a time until the posterior probability that its similarity reaches the threshold is too
small; the rest are decided by their shingle sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import SHINGLE, SIMILAR, MinHash, band_keys, by_group, forest, fresh, least_row, map_arrow, mix, paired_blocks, row_hash, shingle_sets, written
from gable.llm.components import connected_components

#: MinHash values and how many make a band: at similarity 0.8 a pair shares no band with probability 5e-8.
HASHES, ROWS = 128, 4
#: MinHash values compared at a time, and the posterior probability below which a pair goes.
STEP, TOLERANCE = 16, 1e-6
#: Shingles in a block, and what a document weighs beside its own.
BLOCK, LEAST = 600_000, 600


@lru_cache(maxsize=8)
def pruning_table(threshold: float, k: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each step the least number of equal values with which a pair stays, under a uniform prior of the similarity."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, k + 1, step):
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(logs - logs.max())
            if p[s >= threshold].sum() >= tolerance * p.sum():
                break
        out.append(m)
    return tuple(out)


def set_hash(sets: list[np.ndarray]) -> np.ndarray:
    """int64[n, 2]: two independent hashes of each set."""
    out = np.zeros((len(sets), 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            if len(s):
                out[i] = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    return out.view(np.int64)


def verified_pairs(sets: list[np.ndarray], signature: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of `left` with `right` (within left if None) that share a band, survive pruning and reach the threshold."""
    least = pruning_table(threshold, signature.shape[1])
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    found_i, found_j = [], []
    for p, i in enumerate(left):
        others = left[p + 1 :] if right is None else right
        if not len(others):
            continue
        # equal lengths bound the similarity before anything is compared
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[small >= threshold * large - 1e-9]
        others = others[(keys[others] == keys[i]).any(axis=1)]
        equal = np.zeros(len(others), np.int64)
        for at, m in zip(range(0, signature.shape[1], STEP), least):
            if not len(others):
                break
            equal += (signature[others, at : at + STEP] == signature[i, at : at + STEP]).sum(axis=1)
            others, equal = others[equal >= m], equal[equal >= m]
        if not len(others):
            continue
        mark[ids[ends[i] : ends[i + 1]]] = True
        flat = np.concatenate([ids[ends[j] : ends[j + 1]] for j in others])
        cuts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        common = np.add.reduceat(mark[flat].astype(np.int64), cuts)
        mark[ids[ends[i] : ends[i + 1]]] = False
        good = others[common >= threshold * (sizes[i] + sizes[others] - common) - 1e-9]
        found_i.append(np.full(len(good), i))
        found_j.append(good)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, int), np.empty(0, int))


def near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = SIMILAR, n: int = SHINGLE) -> DataFrame:
    """One row per row of docs: ident, class_id, component_id, n_links, kept.

    Words are what stands between white space, in lower case. Two texts are linked when their sets of n-word shingles
    have a Jaccard similarity of `threshold` or more; a text of fewer words is one shingle of all its words; texts that
    are null or hold no word link with nothing. class_id is the smallest id with the same shingles, n_links the number
    of other rows linked (copies included), component_id the smallest id reached by links; the row that bears it is kept.
    Null ids come after all others, so class_id and component_id are null only where every id is. Rows are told apart by
    a 64-bit hash of id and text: of different texts with the smallest id one is kept (the least hash), and
    rows that repeat id and text are all kept or none. An empty table gives an empty one; other columns are not read.

    Shingles are compared as 64-bit hashes. Equal texts are compared once however many there are; other groups are cut
    into blocks (paired_blocks), so neither copies nor near copies of one text gather in one task.
    """
    return _near(docs, ident, text, threshold, n).drop("_r")


def _near(docs: DataFrame, ident: str, text: str, threshold: float, n: int) -> DataFrame:
    """near_copies, with `_r`, the hash of each row. A class goes by the hash of its best row (smallest id, then hash)."""
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_t"), row_hash(ident, text).alias("_r"))

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("_t").to_pylist(), n)
        keys = band_keys(MinHash(HASHES)(sets), ROWS)
        h = set_hash(sets)
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_r"), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))],
            names=["_id", "_r", "h1", "h2", "size", "keys"],
        )

    sketches = written(map_arrow(rows, sketched, f"_id {docs.schema[ident].dataType.simpleString()}, _r long, h1 long, h2 long, size int, keys array<long>"))
    full = sketches.where("size > 0")
    best = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_r").alias("r"))
    classes = full.groupBy("h1", "h2").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
    classes = written(classes.withColumn("rep", F.col("best.r")))
    one = full.select(F.col("_r").alias("rep"), "keys").join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    banded = one.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lead")).where("m > 1").drop("m")
    groups = connected_components(banded.join(shared, "key").where("rep != lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    active = written(groups.join(classes, F.col("id") == F.col("rep")).select("rep", F.col("component").alias("grp"), "copies", "size"))

    texts = rows.join(active.hint("merge"), F.col("_r") == F.col("rep")).select("rep", "grp", "copies", "size", "_t").dropDuplicates(["rep"])
    blocks = paired_blocks(texts, "grp", "rep", F.col("size") + LEAST, BLOCK)

    def compared(table: pa.Table) -> dict | None:
        side, lo, hi = table["side"].to_numpy(), table["lo"][0].as_py(), table["hi"][0].as_py()
        ids, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        a = np.flatnonzero(side == lo)
        b = None if lo == hi else np.flatnonzero(side == hi)
        if not len(a) or (b is not None and not len(b)) or len(ids) < 2:
            return None
        sets = shingle_sets(table["_t"].to_pylist(), n)
        signature = MinHash(HASHES)(sets)
        i, j = verified_pairs(sets, signature, band_keys(signature, ROWS), a, b, threshold)
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        leaf, root = forest(ids[i], ids[j])
        at = np.flatnonzero(links)
        return {"a": [*ids[at].tolist(), *leaf.tolist()], "b": [*ids[at].tolist(), *root.tolist()], "n": [*links[at].astype(int).tolist(), *[0] * len(leaf)]}

    found = written(by_group(blocks, ["grp", "lo", "hi"], compared, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = connected_components(found.where("n = 0")).withColumnRenamed("id", "rep")
    known = classes.join(counts, "rep", "left").join(joined, "rep", "left").withColumn("node", F.coalesce("component", "rep"))
    lead = known.where("component is not null").groupBy(F.col("node").alias("_node")).agg(F.min("best").alias("lead"))
    known = known.join(lead, F.col("node") == F.col("_node"), "left").withColumn("lead", F.coalesce("lead", "best"))
    known = known.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("best.id").alias("rep"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.col("lead.id").alias("k"), F.col("lead.r").alias("kept_r"))
    out = sketches.join(known, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")) & (F.col("size") > 0), "left")
    return out.select(
        F.col("_id").alias(ident),
        F.coalesce("rep", "_id").alias("class_id"),
        F.coalesce("k", "_id").alias("component_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("kept_r", "_r") == F.col("_r")).alias("kept"),
        "_r",
    )


def one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """The rows of docs that near_copies keeps, all columns; of rows that repeat id and text, the one whose columns are least.

    Rows with a null text or one without a word stay; see near_copies for null and repeated ids. Columns may have any
    names. An empty table gives an empty one.
    """
    stayed, row, least = fresh(docs, "stay", "row", "least")
    stay = _near(docs, ident, text, threshold, SHINGLE).where("kept").select(F.col("_r").alias(stayed)).distinct()
    rows = docs.withColumn(row, row_hash(ident, text)).join(stay.hint("merge"), F.col(row) == F.col(stayed), "left_semi")
    return rows.groupBy(row).agg(least_row(docs).alias(least)).select(f"{least}.*")
