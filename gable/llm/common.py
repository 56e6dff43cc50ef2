"""Helpers shared by the corpus operators: shared scratch space, word shingles, MinHash and bounded pair blocks."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle, and the similarity from which two texts count as near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Bytes of text that a function sees at a time, about, and words whose hashes a task remembers.
SLICE, REMEMBERED = 2 << 20, 250_000

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and see that a checkpoint folder is set.

    The folder is the cluster's own (spark.checkpoint.dir); only in local mode, as in tests, a temporary one is made
    where it is unset. On a cluster an unset folder is an error: executors don't share the driver's folders. Where
    the size of Arrow batches is Spark's default of 64 MB it becomes 8 MB, so that both sides of a task hold less.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in path.split(":"):
        sc.environment["PYTHONPATH"] = f"{_ROOT}:{path}".rstrip(":")
    if not sc.getConf().get("spark.checkpoint.dir", "") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, "8m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ready(spark)
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, knows its size.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df bears."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while (n := f"_{n}") in taken:
            pass
        out.append(n)
    return out


def row_hash(ident: str, text: str) -> Column:
    """64 bits that tell rows apart by id and text; null ids and repeated ones too."""
    return F.xxhash64(F.col(ident).isNull(), F.col(ident), F.col(text))


def least_row(df: DataFrame) -> Column:
    """Aggregate: the row of df, as a struct, whose columns are least; maps and variants, which have no order, go by their text."""
    plain = lambda c: not any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant"))
    quoted = {c: F.col(f"`{c}`") for c in df.columns}
    return F.min_by(F.struct(*quoted.values()), F.struct(*[q if plain(c) else F.to_json(F.struct(q)) for c, q in quoted.items()]))


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """batch in parts of about `most` bytes of strings and binaries; a longer row is a part of its own."""
    size = np.full(batch.num_rows, 16, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - 1) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """At the end of a task: forget words and give free memory back to the system, as workers outlive their tasks."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to the rows of df, some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := fn(part)) is not None:
                    yield out
        release()

    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = WordHash()


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in one array, and where each text starts in it (one more than texts)."""
    get = _HASHES.__getitem__
    rows = [np.array(list(map(get, words_of(t))), dtype=np.uint64) for t in texts]
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=starts[1:])
    return (np.concatenate(rows) if rows else np.empty(0, np.uint64)), starts


def grams(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, by the place of the first; over the last n - 1 places fewer."""
    out = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out *= _P
            if i < len(flat):
                out[: len(flat) - i] += flat[i:]
        return mix(out)


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles; of a shorter text with words, one of all its words."""
    flat, starts = word_hashes(texts)
    g = grams(flat, n)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(grams(np.append(flat[a:b], np.uint64(b - a)), int(b - a + 1))[:1])
        else:
            out.append(np.empty(0, np.uint64))
    return out


class MinHash:
    """k MinHash values per set, the same for the same seed on every machine."""

    def __init__(self, k: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """uint32[len(sets), k]; empty sets get the largest value throughout."""
        out = np.full((len(sets), len(self.a)), 0xFFFFFFFF, np.uint32)
        full = [i for i, s in enumerate(sets) if len(s)]
        at = 0
        with np.errstate(over="ignore"):
            while at < len(full):
                end, size = at, 0
                while end < len(full) and (end == at or size + len(sets[full[end]]) <= 32_768):
                    size += len(sets[full[end]])
                    end += 1
                part = full[at:end]
                flat = np.concatenate([sets[i] for i in part])
                starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in part])[:-1]])
                for k in range(len(self.a)):
                    out[part, k] = np.minimum.reduceat(((flat * self.a[k] + self.b[k]) >> np.uint64(32)).astype(np.uint32), starts)
                at = end
        return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """int64[n, bands]: a hash of each `rows` consecutive MinHash values and the band's number."""
    n, k = signature.shape
    bands = k // rows
    out = np.empty((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(n, b + 1, np.uint64)
            for r in range(rows):
                h = mix(h * _P + signature[:, b * rows + r].astype(np.uint64))
            out[:, b] = h
    return out.view(np.int64)


def paired_blocks(df: DataFrame, key: str, ident: str, weight: Column, most: int, members: DataFrame | None = None) -> DataFrame:
    """Deal the rows of each key into blocks of about `most` weight; each row goes to every pair of blocks with its own.

    Adds `lo` and `hi` (the pair) and `side` (the row's own block). Compare rows of different sides, or within a pair
    of equal blocks all rows: each two rows of a key then meet once, and no group holds more than two blocks.
    Keys of one row go. The number of blocks follows the key's size, so no key grows into one task. members: a table that
    has the key once for each row of df, if that is cheaper to count than df.
    """
    sized = (df if members is None else members).groupBy(key).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = sized.select(F.col(key).alias("_k"), F.greatest(F.lit(1), F.ceil(F.col("_w") / F.lit(most))).cast("int").alias("_nb"))
    out = df.join(sized, df[key] == sized["_k"]).drop("_k")
    out = out.withColumn("side", F.pmod(F.xxhash64(ident), F.col("_nb")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return out.withColumn("lo", F.least("side", "_o")).withColumn("hi", F.greatest("side", "_o")).drop("_o", "_nb")


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict[str, list] | None], schema: str) -> DataFrame:
    """Stream sorted partitions and call fn once for the rows of each key; groups must be bounded (see paired_blocks)."""
    ready(df.sparkSession)
    names = [f.split()[0] for f in schema.split(",")]

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = {f.split()[0]: kinds[f.split()[1]] for f in schema.split(",")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in names}
        rest: list[pa.RecordBatch] = []

        def add(table: pa.Table) -> None:
            got = fn(table)
            if got:
                for n in names:
                    out[n].extend(got[n])

        def flush():
            batch = pa.RecordBatch.from_pydict({n: pa.array(out[n], type=types[n]) for n in names})
            for n in names:
                out[n].clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.zeros(batch.num_rows, bool)
            for k in keys:
                v = batch.column(k).to_numpy(zero_copy_only=False)
                marks[1:] |= v[1:] != v[:-1]
            if rest:
                last = rest[-1]
                marks[0] = any(last.column(k)[last.num_rows - 1] != batch.column(k)[0] for k in keys)
            cuts = np.flatnonzero(marks)
            at = 0
            for c in cuts:
                if c > at:
                    rest.append(batch.slice(at, c - at))
                if rest:
                    add(pa.Table.from_batches(rest))
                    rest = []
                at = int(c)
            rest.append(batch.slice(at))
            if len(out[names[0]]) > 20_000:
                yield flush()
        if rest:
            add(pa.Table.from_batches(rest))
        if out[names[0]]:
            yield flush()
        release()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b, each node against the smallest of its tree."""
    if not len(a):
        return a, b
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while True:
            nxt = new[new]
            if (nxt == new).all():
                break
            new = nxt
        if (new == root).all():
            break
        root = new
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaf], nodes[root[leaf]]
