"""Error metrics of many resamples at once: a matrix of weights (rows x rounds) for each batch of rows, and its products.

A row's weight in a round follows from a 32-bit key of the row and the round's number, so no row is copied for a round.
Tasks add up products of the weight matrix with the error columns and weights by bucket of the relative error; the bucket
that holds a round's median follows from these sums, and only rows of such buckets are looked at again. Buckets get
narrower towards the middle, where the medians of all rounds lie, so that about sqrt(rows) of them are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.operators.store import written

METRICS = ["r2", "rmse", "smape", "medape"]
#: Rows whose weights stand in memory together.
CHUNK = 256
#: Sums kept for every round: weight, and weighted truth, its square, squared error, symmetric error, rows with a relative error.
_SUMS = 6
_POINTS = sorted({0.5 + s * 2.0**-j * (1 + h / 2) / 2 for j in range(1, 14) for h in (0, 1) for s in (-1, 1)} | {0.5, 0.1, 0.9})

#: uint32 keys of rows -> their weights, uint8[rows, rounds]
Weigh = Callable[[np.ndarray], np.ndarray]


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are numbers."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def row_key(seed: int, *ident: Column) -> Column:
    """32 bits of a hash of seed and ident."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(i.cast("string"), F.lit("")) for i in ident])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draws(keys: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """uint32[keys, rounds]: uniform draws, a 32-bit finaliser (xor, shift and multiply) of key and round."""
    h = keys.astype(np.uint32)[:, None] + (rounds.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B9)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def poisson_edges(most: int = 8) -> list[int]:
    """Draws from which a row is taken once, twice, ... in a bootstrap round."""
    total, term, out = 0.0, float(np.exp(-1.0)), []
    for k in range(most):
        total += term
        term /= k + 1
        out.append(int(np.ceil(total * 2.0**32)))
    return [e for e in out if e < 1 << 32]


def bootstrap_weights(rounds: int) -> Weigh:
    edges = poisson_edges()

    def weigh(keys: np.ndarray) -> np.ndarray:
        u = draws(keys, np.arange(rounds))
        out = np.zeros(u.shape, np.uint8)
        for e in edges:
            out += u >= np.uint32(e)
        return out

    return weigh


def _codes(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[int]]:
    """Number of each row's combination of the first n columns, and a row of each."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(n):
        d = batch.column(i).dictionary_encode()
        one = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.unique(code * (len(d.dictionary) + 1) + one, return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first.tolist()


def _floats(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False)


def matrix_metrics(df: DataFrame, keys: list[str], y: str, p: str, key: Column, weigh: Weigh, rounds: int) -> DataFrame:
    """(keys, round, r2, rmse, smape, medape) of each column of weights; rows without a truth or a prediction are left out.

    A relative error needs a truth that is not 0. Null keys are a group; a round that draws no row of a group has nulls, and no r2
    where all truths it draws are equal.
    """
    group = keys or ["_all"]
    t, q = F.col(y).cast("double"), F.col(p).cast("double")
    base = complete(df if keys else df.withColumn("_all", F.lit(0)), y, p)
    apart = F.coalesce(2 * F.abs(F.col("_t") - F.col("_q")) / F.nullif(F.abs("_t") + F.abs("_q"), F.lit(0.0)), F.lit(0.0))
    base = base.select(*group, key.alias("_key"), t.alias("_t"), q.alias("_q"), (F.abs(t - q) / F.nullif(F.abs(t), F.lit(0.0))).alias("_v"))
    edges = base.groupBy(*group).agg(F.avg("_t").alias("_mean"), F.array_distinct(F.percentile_approx("_v", F.array(*map(F.lit, _POINTS)), 20_000)).alias("_edges"))
    edges = written(edges)  # sketches depend on the order of rows: both passes below must see the same buckets
    base = base.join(edges.select(*[F.col(g).alias(f"_g_{g}") for g in group], "_edges", "_mean"), _same(group))
    bucket = F.when(F.col("_v").isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col("_v")))).otherwise(-1)
    # work per row is many times its size: at least a task a core
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # truths from their mean, so that sums of squares keep their digits
    base = base.select(*group, "_key", (F.col("_t") - F.col("_mean")).alias("_t"), (F.col("_q") - F.col("_mean")).alias("_q"), "_v", bucket.alias("_b"), apart.alias("_s")).repartition(tasks, "_key")
    kinds = ", ".join(f"`{g}` {base.schema[g].dataType.simpleString()}" for g in group)
    g = len(group)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types = None

        def flush() -> pa.RecordBatch:
            names, values = list(held), list(held.values())
            heads = [pa.array([n[i] for n in names], types[i]) for i in range(g)]
            slot = pa.array([n[g] for n in names], pa.int32())
            batch = pa.RecordBatch.from_arrays([*heads, slot, pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], [*group, "slot", "sums"])
            held.clear()
            return batch

        for batch in batches:
            types = types or [batch.column(i).type for i in range(g)]
            code, first = _codes(batch, g)
            names = [tuple(batch.column(i)[r].as_py() for i in range(g)) for r in first]
            order = np.lexsort((_floats(batch, g + 4), code))
            row_keys, t, q, b, s = (_floats(batch, g + i)[order] for i in (0, 1, 2, 4, 5))
            code = code[order]
            columns = np.column_stack([np.ones(len(t)), t, t * t, (t - q) ** 2, s, b >= 0])
            for c in range(len(first)):
                lo, hi = np.searchsorted(code, [c, c + 1])
                for a in range(lo, hi, CHUNK):
                    z = min(hi, a + CHUNK)
                    w = weigh(row_keys[a:z].astype(np.uint32))
                    for i, s in enumerate((w.T.astype(np.float64) @ columns[a:z]).T):
                        at = (*names[c], -1 - i)
                        held[at] = held[at] + s if at in held else s
                    cut = np.flatnonzero(np.concatenate([[True], b[a + 1 : z] != b[a : z - 1]]))
                    for k, s in zip(b[a:z][cut].astype(int).tolist(), np.add.reduceat(w, cut, axis=0, dtype=np.int64)):
                        if k >= 0:
                            at = (*names[c], k)
                            held[at] = held[at] + s if at in held else s.astype(np.float64)
            if len(held) > 4096:
                yield flush()
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        total = table["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(axis=0)
        return table.slice(0, 1).set_column(g + 1, "sums", pa.array([total.tolist()], pa.list_(pa.float64())))

    parts = base.mapInArrow(sums, f"{kinds}, slot int, sums array<double>")
    # a group is one bucket of one key: an array a task
    whole = parts.groupBy(*group, "slot").applyInArrow(add, f"{kinds}, slot int, sums array<double>")

    def metrics(table: pa.Table) -> pa.Table:
        """Metrics that are sums, and for both ranks around the middle of each round the bucket that holds it."""
        slot = table["slot"].to_numpy()
        values = table["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(slot), -1)
        w, wt, wtt, we, ws, wv = (values[np.flatnonzero(slot == -1 - i)[0]] for i in range(_SUMS))
        order = np.argsort(slot)
        order = order[slot[order] >= 0]
        cum = np.cumsum(values[order], axis=0) if len(order) else np.zeros((1, rounds))
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = wtt - wt * wt / w
            out = {"r2": np.where(spread > 1e-10 * wtt, 1 - we / spread, np.nan), "rmse": np.sqrt(we / w), "smape": 100 * ws / w}
        k = (wv - 1) / 2
        rows = []
        for which, rank in ((0, np.floor(k)), (1, np.ceil(k))):
            i = np.minimum((cum <= rank).sum(axis=0), len(cum) - 1)
            before = np.where(i > 0, cum[np.maximum(i - 1, 0), np.arange(rounds)], 0.0)
            ok = wv > 0
            rows.append((np.full(rounds, which), np.where(ok, slot[order][i] if len(order) else -1, -1), rank - before, k - np.floor(k)))
        which, b, rank, part = (np.concatenate(c) for c in zip(*rows))
        each = [np.tile(np.where(np.isfinite(v), v, np.nan), 2) for v in out.values()]
        heads = [pa.array([table[c][0].as_py()] * (2 * rounds), table[c].type) for c in group]
        numbers = [pa.array(np.tile(np.arange(rounds), 2), pa.int32()), pa.array(which, pa.int32()), pa.array(b, pa.int32()), pa.array(rank), pa.array(part), *[pa.array(v, from_pandas=True) for v in each]]
        return pa.Table.from_arrays([*heads, *numbers], [*group, "round", "which", "_b", "_rank", "_part", *out])

    found = whole.groupBy(*group).applyInArrow(metrics, f"{kinds}, round int, which int, _b int, _rank double, _part double, r2 double, rmse double, smape double")
    found = found.persist()  # rounds x groups rows, used three times

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weights of every round by value, for rows of the buckets that hold a middle."""
        for batch in batches:
            code, first = _codes(batch, g)
            v, b = _floats(batch, g + 3), _floats(batch, g + 4)
            order = np.lexsort((v, b, code))
            code, v, b, row_keys = code[order], v[order], b[order], _floats(batch, g)[order].astype(np.uint32)
            for a in range(0, len(v), CHUNK):
                z = min(len(v), a + CHUNK)
                new = np.concatenate([[True], (v[a + 1 : z] != v[a : z - 1]) | (b[a + 1 : z] != b[a : z - 1]) | (code[a + 1 : z] != code[a : z - 1])])
                cut = np.flatnonzero(new)
                w = np.add.reduceat(weigh(row_keys[a:z]), cut, axis=0, dtype=np.int32)
                at = [first[c] for c in code[a:z][cut]]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(at)) for i in range(g)], pa.array(b[a:z][cut].astype(np.int32)), pa.array(v[a:z][cut]), pa.array([x.tobytes() for x in w], pa.binary())], [*group, "_b", "_v", "_w"])

    def middle(left: pa.Table, right: pa.Table) -> pa.Table:
        """The value at each wanted rank of a bucket."""
        value = left["_v"].to_numpy()
        order = np.argsort(value, kind="stable")
        cum = np.cumsum(np.stack([np.frombuffer(x, np.int32) for x in left["_w"].to_pylist()])[order] if len(order) else np.zeros((0, rounds)), axis=0)
        r, rank = right["round"].to_numpy(), right["_rank"].to_numpy()
        at = value[order][(cum[:, r] <= rank).sum(axis=0)] if len(order) else np.empty(0)
        return right.select([*group, "round", "which"]).append_column("_at", pa.array(at, pa.float64()))

    wanted = found.where("_b >= 0").select(*group, "_b", "round", "which", "_rank")
    near = base.join(wanted.select(*[F.col(c).alias(f"_g_{c}") for c in [*group, "_b"]]).distinct(), _same([*group, "_b"])).select(*base.columns)
    looked = near.mapInArrow(weights, f"{kinds}, _b int, _v double, _w binary")
    ends = looked.groupBy(*group, "_b").cogroup(wanted.groupBy(*group, "_b")).applyInArrow(middle, f"{kinds}, round int, which int, _at double")
    ends = ends.groupBy(*group, "round").agg(*[F.max(F.when(F.col("which") == i, F.col("_at"))).alias(n) for i, n in ((0, "_lo"), (1, "_hi"))])
    ends = ends.select(*[F.col(c).alias(f"_g_{c}") for c in [*group, "round"]], "_lo", "_hi")
    out = found.where("which = 0").join(ends, _same([*group, "round"]), "left")
    return out.select(*keys, "round", "r2", "rmse", "smape", (100 * (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))).alias("medape"))


def _same(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(n).eqNullSafe(F.col(f"_g_{n}"))
    return out


def round_metrics(df: DataFrame, rounds: int, keys: list[str], y: str, p: str, ident: str = "id", seed: int = 42) -> DataFrame:
    """(keys, round, r2, rmse, smape, medape) of each bootstrap round, rows taken as often as they are drawn (Poisson)."""
    return matrix_metrics(df, keys, y, p, row_key(seed, F.col(ident)), bootstrap_weights(rounds), rounds)


def halving_draws(pooled: DataFrame, key: Column, rounds: int) -> np.ndarray:
    """For each round the draw (with the row's key behind it) up to which a row belongs to the first half of pooled.

    The draw of that rank is found by counting: draws well below the middle are counted, those around it (six standard
    deviations) are sorted by round, about 6 sqrt(rows) a round. Raises if a rank lies outside.
    """
    n = pooled.count()
    reach = min(0.5, 3.0 / max(n, 1) ** 0.5)
    low, high = (int((0.5 + s * reach) * 2**32) for s in (-1, 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(rounds, np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            near: list[list[np.ndarray]] = []
            for a in range(0, len(keys), CHUNK):
                k = keys[a : a + CHUNK]
                u = draws(k, np.arange(rounds)).astype(np.int64)
                below += (u < low).sum(axis=0)
                row, r = np.nonzero((u >= low) & (u < high))
                near.append([r, (u[row, r] << 32) | k[row].astype(np.int64)])
            r, u = (np.concatenate(c) for c in zip(*near)) if near else (np.empty(0, np.int64),) * 2
            order = np.argsort(r, kind="stable")
            cuts = np.searchsorted(r[order], np.arange(rounds + 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array([0] * rounds, pa.int64()), pa.array([u[order][a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["round", "below", "near"])
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(below), pa.array([b""] * rounds, pa.binary())], ["round", "below", "near"])

    def ranked(table: pa.Table) -> pa.Table:
        near = np.sort(np.concatenate([np.frombuffer(x, np.int64).view(np.uint64) for x in table["near"].to_pylist()]))
        rank = n // 2 - 1 - int(table["below"].to_numpy().sum())
        if not 0 <= rank < len(near):
            raise RuntimeError("the middle draw of a round lies far off")
        return pa.table({"round": table["round"].slice(0, 1), "until": pa.array([near[rank]], pa.uint64()).cast(pa.decimal128(20, 0))})

    tasks = max(pooled.sparkSession.sparkContext.defaultParallelism, int(pooled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = pooled.select(key.alias("key")).repartition(tasks, "key").mapInArrow(counted, "round int, below bigint, near binary").groupBy("round").applyInArrow(ranked, "round int, until decimal(20,0)")
    return np.array([int(r["until"]) for r in got.orderBy("round").collect()], np.uint64)  # a number a round


def pooled_metrics(df: DataFrame, y: str, first: str, second: str, rounds: int, ident: str = "id", seed: int = 42) -> DataFrame:
    """(round, half, r2, rmse, smape, medape): the predictions of both models pooled with their truths, half of them, chosen anew each round, against the rest (half 0 and 1).

    Rows need a truth and both predictions. The half is exact: those whose draw is among the n least of 2 n.
    """
    whole = complete(df, y, first, second)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("p")) for n, c in (("0", first), ("1", second))]))
    pooled = whole.select(F.col(ident).alias("_id"), F.col(y).alias("_y"), each.alias("_x")).select("_id", "_y", "_x.*")
    key = row_key(seed, F.col("_id"), F.col("model"))
    until = halving_draws(pooled, key, rounds)

    def weigh(keys: np.ndarray) -> np.ndarray:
        u = (draws(keys, np.arange(rounds)).astype(np.uint64) << np.uint64(32)) | keys.astype(np.uint64)[:, None]
        half = (u <= until).astype(np.uint8)
        return np.concatenate([half, 1 - half], axis=1)

    out = matrix_metrics(pooled, [], "_y", "p", key, weigh, 2 * rounds)
    return out.withColumns({"half": F.floor(F.col("round") / rounds).cast("int"), "round": (F.col("round") % rounds).cast("int")})
