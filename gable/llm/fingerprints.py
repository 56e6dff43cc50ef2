"""Bottom-k sketches of word shingles: small, mergeable fingerprints that estimate resemblance, containment and distinct shingles.

A sketch holds the SIZE smallest of the 40-bit hashes of a text's distinct shingles, in order, five bytes each. A text of
fewer shingles is held whole, and all estimates from such sketches are exact but for equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import SHINGLE, fresh, map_arrow, ready, release, shingle_sets, slices

#: Hashes in a sketch, and their bits. The error of a resemblance J is about sqrt(J (1 - J) / SIZE), 0.044 at most.
SIZE, BITS = 128, 40
_BYTES = BITS // 8


def bottom(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The smallest of sorted 64-bit hashes, as values of BITS bits."""
    h = hashes >> np.uint64(64 - BITS)
    return h[np.concatenate([[True], h[1:] != h[:-1]])][:size] if len(h) else h


def packed_sketch(values: np.ndarray) -> bytes:
    """Five bytes a value, the highest first: sketches compare as their values do."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :]).tobytes()


def unpacked_sketch(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _BYTES, 8), np.uint8)
    wide[:, 8 - _BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


def sketches_of(texts: list[str | None], size: int = SIZE, n: int = SHINGLE) -> list[np.ndarray]:
    return [bottom(s, size) for s in shingle_sets(texts, n)]


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the union of two sets of shingles."""
    return np.union1d(a, b)[:size]


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """How many distinct shingles: counted if there are fewer than size, else estimated from the largest value held."""
    return float(len(a)) if len(a) < size else (size - 1) * 2.0**BITS / (float(a[-1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty one is like no other."""
    union = merge(a, b, size)
    if not len(union):
        return 1.0
    return np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b holds; 1 if a is empty."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, size) * distinct(merge(a, b, size), size) / distinct(a, size))


def sketched(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SIZE, n: int = SHINGLE) -> DataFrame:
    """(ident, sketch) of every row; null and empty texts, and texts without a word, have an empty sketch. A text of fewer than n words is one shingle."""

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [packed_sketch(s) for s in sketches_of(part.column(1).to_pylist(), size, n)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], [ident, "sketch"])

    rows = docs.select(F.col(ident), F.col(text).cast("string").alias("_t"))
    return map_arrow(rows, fn, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, sketch binary")


def merged(parts: DataFrame, key: str, sketch: str = "sketch", size: int = SIZE) -> DataFrame:
    """(key, sketch) of the union of each key's parts; null keys are one key, null sketches count as empty.

    Parts are merged in their task before they are shuffled, so a key has at most a few sketches a task, however many parts
    it has; a task remembers a bounded number of keys.
    """
    kind = parts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held, key_type), pa.array(map(packed_sketch, held.values()), pa.binary())], [key, "sketch"])
            held.clear()
            return batch

        key_type = pa.null()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = unpacked_sketch(v or b"")
                held[k] = merge(held[k], s, size) if k in held else s[:size]
                if len(held) >= 10_000:
                    yield flush()
        if held:
            yield flush()
        release()

    ready(parts.sparkSession)
    once = parts.select(F.col(key), F.col(sketch).alias("sketch")).mapInArrow(run, f"`{key}` {kind}, sketch binary")
    twice = once.repartition(key).sortWithinPartitions(key)
    return _by_run(twice, key, kind, size)


def _by_run(rows: DataFrame, key: str, kind: str, size: int) -> DataFrame:
    """Merge neighbours of one key in partitions that are sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, held = False, None, np.empty(0, np.uint64)
        key_type = pa.null()
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, out = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = unpacked_sketch(v)
                if begun and k == last:
                    held = merge(held, s, size)
                    continue
                if begun:
                    keys.append(last)
                    out.append(packed_sketch(held))
                begun, last, held = True, k, s
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(out, pa.binary())], [key, "sketch"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([last], key_type), pa.array([packed_sketch(held)], pa.binary())], [key, "sketch"])

    return rows.mapInArrow(run, f"`{key}` {kind}, sketch binary")


def compared(pairs: DataFrame, a: str, b: str, size: int = SIZE) -> DataFrame:
    """pairs with `resemblance`, `a_in_b`, `b_in_a` and the numbers of distinct shingles `a_shingles`, `b_shingles` of two columns of sketches; null counts as empty."""
    names = [c for c in pairs.columns if c not in ("resemblance", "a_in_b", "b_in_a", "a_shingles", "b_shingles")]
    kinds = dict(pairs.select(*[F.col(f"`{n}`") for n in names]).dtypes)
    left, right = fresh(pairs, "a", "b")

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ([unpacked_sketch(v or b"") for v in part.column(part.num_columns + i).to_pylist()] for i in (-2, -1))
        five = [[f(p, q) for p, q in zip(x, y)] for f in (lambda p, q: resemblance(p, q, size), lambda p, q: containment(p, q, size), lambda p, q: containment(q, p, size), lambda p, q: distinct(p, size), lambda p, q: distinct(q, size))]
        return pa.RecordBatch.from_arrays([*part.columns[:-2], *[pa.array(f, pa.float64()) for f in five]], [*names, "resemblance", "a_in_b", "b_in_a", "a_shingles", "b_shingles"])

    schema = ", ".join([*[f"`{n}` {kinds[n]}" for n in names], "resemblance double, a_in_b double, b_in_a double, a_shingles double, b_shingles double"])
    return map_arrow(pairs.select(*[F.col(f"`{n}`") for n in names], F.col(a).alias(left), F.col(b).alias(right)), fn, schema)


def _edited(text: str, following: str) -> str:
    """text with its last half replaced by as many characters from the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "n_chars bigint, edited_sha256 string, sketch binary, edited binary, near_edited double, near_next double, shingles double, kept double"


def _results(texts: list[str], following: list[str], own: list[np.ndarray], theirs: list[np.ndarray]) -> dict[str, list]:
    """What is known of documents and those that follow them."""
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    new = sketches_of(edited)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        "sketch": [packed_sketch(s) for s in own],
        "edited": [packed_sketch(s) for s in new],
        "near_edited": [resemblance(a, b) for a, b in zip(own, new)],
        "near_next": [resemblance(a, b) for a, b in zip(own, theirs)],
        "shingles": [distinct(a) for a in own],
        "kept": [containment(a, b) for a, b in zip(own, new)],
    }


#: Ranges at most, and rows of the sample for each range.
RANGES, SAMPLED = 1 << 16, 16


def _ranged(rows: DataFrame) -> DataFrame:
    """rows (_id, _h, ...) with `_range`: how many of the edges are not greater than (_id, _h), nulls first; four ranges a shuffle partition."""
    spark, n = rows.sparkSession, rows.count()
    ranges = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 64, RANGES))
    share = F.pmod(F.xxhash64("_id", "_h", F.lit(1)), F.lit(max(1, n // (ranges * SAMPLED))))
    sample = rows.where(share == 0).select("_id", "_h").distinct().sort("_id", "_h").collect() if ranges > 1 else []
    edges = [tuple(sample[i * len(sample) // ranges]) for i in range(1, ranges)] if sample else []
    edges = list(dict.fromkeys(edges))
    if not edges:
        return rows.withColumn("_range", F.lit(0))
    # two steps: which stretch of about sqrt(edges), then how many edges within it
    step = max(1, round(len(edges) ** 0.5))
    kind = f"array<struct<id:{rows.schema['_id'].dataType.simpleString()},h:bigint>>"
    parts = [edges[i : i + step] for i in range(0, len(edges), step)]
    table = spark.createDataFrame([([p[0] for p in parts], parts)], f"_coarse {kind}, _fine array<{kind}>")
    upto = lambda edges: F.size(F.filter(edges, lambda e: e <= F.struct(F.col("_id").alias("id"), F.col("_h").alias("h"))))
    cut = rows.join(F.broadcast(table)).withColumn("_c", upto(F.col("_coarse")))
    inside = F.when(F.col("_c") > 0, (F.col("_c") - 1) * step + upto(F.element_at("_fine", F.greatest("_c", F.lit(1))))).otherwise(0)
    return cut.withColumn("_range", inside.cast("int")).drop("_coarse", "_fine", "_c")


_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]


def edited_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half is the beginning of the next document.

    One row per row of docs: ident, n_chars, edited_sha256, fingerprint and edited_fingerprint (base64), near_edited, near_next
    (estimated resemblance), n_shingles (estimated) and kept_share (estimated share of the shingles that the edited text
    still holds). The next document has the next smaller ident, null idents come last, rows of one ident go by a hash of their
    text; after the last comes the first, so a single row is followed by itself. A null text is empty; two texts without a word
    are alike (1). Other columns are not read; an empty table gives an empty one.

    Documents are dealt to ranges of (ident, hash of the text), whose edges come from a bounded sample, so ranges are even and the
    same in every pass; the first document of each range is sent to the range before it as well. Whole texts are shuffled
    once and nothing is written. Each task holds a few megabytes.
    """
    spark = ready(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    ranged = _ranged(rows)
    # a row a range, at most RANGES: where the first documents of ranges go besides
    first = sorted(((r["_range"], tuple(r["_head"])) for r in ranged.groupBy("_range").agg(F.max(F.struct("_id", "_h")).alias("_head")).collect()), key=lambda x: x[0])
    after = [r for r, _ in first[1:] + first[:1]]
    heads = spark.createDataFrame([(r, h, a) for (r, h), a in zip(first, after)], f"_range int, _head struct<_id:{kind},_h:bigint>, _also int")
    both = F.array_compact(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")), F.when(F.struct("_id", "_h") == F.col("_head"), F.struct(F.col("_also").alias("range"), F.lit(1).alias("guest")))))
    dealt = ranged.join(F.broadcast(heads), "_range").select("_id", "_t", "_h", F.explode(both).alias("_d")).select("_id", "_t", "_h", "_d.range", "_d.guest")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "guest", F.desc_nulls_last("_id"), F.desc("_h")).select("_id", "_t", "range", "guest")
    names = ["_id", *[f.split()[0] for f in _FIELDS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = None  # the row before, with its range
        for whole in batches:
            for part in slices(whole):
                ids, texts, where, guest = part.column(0), *[part.column(i).to_pylist() for i in (1, 2, 3)]
                own = sketches_of(texts)
                if waits is not None:
                    ids = pa.concat_arrays([waits[0], ids])
                    texts, where, guest, own = [waits[1], *texts], [waits[2], *where], [waits[3], *guest], [waits[4], *own]
                # the row after a range's last one is its guest
                at = [i for i in range(len(texts) - 1) if not guest[i] and where[i] == where[i + 1]]
                if at:
                    got = _results([texts[i] for i in at], [texts[i + 1] for i in at], [own[i] for i in at], [own[i + 1] for i in at])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.array(got[c], k) for c, k in zip(names[1:], _TYPES)]], names)
                waits = (ids[-1:], texts[-1], where[-1], guest[-1], own[-1])
        release()

    line = lambda c: F.regexp_replace(F.base64(c), r"\s", "")
    return dealt.mapInArrow(run, f"_id {kind}, {_FIELDS}").select(
        F.col("_id").alias(ident),
        "n_chars",
        "edited_sha256",
        line("sketch").alias("fingerprint"),
        line("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.round("shingles").cast("long").alias("n_shingles"),
        F.col("kept").alias("kept_share"),
    )
