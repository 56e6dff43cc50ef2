"""Runs of words that repeat with a period, found in a Re-Pair grammar of the text.

Words become ids. Re-Pair replaces repeated pairs of neighbours by nonterminals until no pair of a text repeats; what is
left is paired up into a balanced tree. A run lies in some lowest node of the derivation and crosses the boundary of its
two halves. So runs that cross a boundary are computed once for each nonterminal, at its first occurrence, carried to
every position that the nonterminal derives, and pieces of one period that overlap by a period or more are one run.
Texts are handled some megabytes at a time in numpy; documents of a batch share no symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.llm.common import map_arrow, mix

#: A run holds at least this many words and this many periods.
LEAST, PERIODS = 6, 4
#: Boundaries and periods that are looked at together.
TESTS = 2_000_000

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Grammar:
    """Rules symbol -> left right over the ids of all texts of a batch, and the sequence that is left.

    length and first hold each symbol's number of words and the position of its first occurrence; sequence and at are
    the symbols that are left and where they start. rounds are the ranges of symbols made together: their parts are older.
    """

    def __init__(self, ids: np.ndarray, symbols: int):
        s, at = ids.astype(np.int64), np.arange(len(ids))
        left, right = [np.full(symbols, -1)], [np.full(symbols, -1)]
        length, first = [np.ones(symbols, np.int64)], [np.zeros(symbols, np.int64)]
        first[0][s[::-1]] = at[::-1]
        known, made = np.empty(0, np.int64), np.empty(0, np.int64)
        self.rounds: list[tuple[int, int]] = []
        alive = np.ones(len(s), bool)  # by the first symbol of a pair: the pair may repeat
        alive[-1:] = False
        every = True
        while (pairs := np.flatnonzero(alive)).size:
            keys, which, count = np.unique((s[pairs] << 32) | s[pairs + 1], return_inverse=True, return_counts=True)
            place = np.searchsorted(known, keys)
            old = np.zeros(len(keys), bool)
            inside = place < len(known)
            old[inside] = known[place[inside]] == keys[inside]
            repeats = (count > 1) | old
            alive[pairs[~repeats[which]]] = False  # a pair that is alone mostly stays alone until one of its symbols changes
            if not repeats.any():
                if every:
                    break
                alive[:-1] = every = True  # but a symbol made again may join its like, so at last all are counted
                continue
            every = False
            # the most frequent pairs first: a pair is replaced where no neighbour that overlaps it is more frequent
            worth = np.zeros(len(keys), np.int64)
            worth[np.lexsort((mix(keys.view(np.uint64)), count))] = np.arange(1, len(keys) + 1)
            rank = np.zeros(len(s), np.int64)
            rank[pairs] = np.where(repeats, worth, 0)[which]
            start = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            stretch = rank[start]
            wins = (stretch > 0) & (stretch > np.append(stretch[1:], 0)) & (stretch > np.concatenate([[0], stretch[:-1]]))
            of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(s))))
            chosen = np.flatnonzero(wins[of] & ((np.arange(len(s)) - start[of]) % 2 == 0))
            key, where, back = np.unique((s[chosen] << 32) | s[chosen + 1], return_index=True, return_inverse=True)
            place = np.searchsorted(known, key)
            name = np.full(len(key), -1)
            inside = place < len(known)
            inside[inside] = known[place[inside]] == key[inside]
            name[inside] = made[place[inside]]
            new = np.flatnonzero(name < 0)
            name[new] = symbols + np.arange(len(new))
            lengths = np.concatenate(length)
            a, b = key[new] >> 32, key[new] & 0xFFFFFFFF
            left.append(a)
            right.append(b)
            length.append(lengths[a] + lengths[b])
            first.append(at[chosen[where[new]]])
            length, self.rounds = [np.concatenate(length)], [*self.rounds, (symbols, symbols + len(new))]
            symbols += len(new)
            known, made = np.append(known, key[new]), np.append(made, name[new])
            order = np.argsort(known)
            known, made = known[order], made[order]
            s[chosen] = name[back]
            alive[chosen] = True
            alive[chosen[chosen > 0] - 1] = True
            keep = np.ones(len(s), bool)
            keep[chosen + 1] = False
            s, at, alive = s[keep], at[keep], alive[keep]
            alive[-1:] = False
        self.left, self.right, self.length, self.first = np.concatenate(left), np.concatenate(right), np.concatenate(length), np.concatenate(first)
        self.sequence, self.at = s, at


def tree(at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, middle, high) of the nodes above the starts `at`, paired level by level within texts that end at `ends`."""
    text = np.searchsorted(ends, at, side="right")
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(at) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(at)))
    at = np.append(at, ends[-1] if len(ends) else 0)
    low, middle, high = [], [], []
    step = 1
    while len(size) and step < size.max():
        many = np.maximum(0, -(-(size - step) // (2 * step)))  # nodes with a right half
        j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        g, n = np.repeat(begin, many) + j * 2 * step, np.repeat(size, many) - j * 2 * step
        low.append(at[g])
        middle.append(at[g + step])
        high.append(np.where(n > 2 * step, at[np.minimum(g + 2 * step, len(at) - 1)], ends[text[g]] if len(g) else 0))
        step *= 2
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(low), join(middle), join(high)


class Words:
    """Word ids with prefix sums by which equal stretches are told; what the sums call equal is compared word by word after."""

    def __init__(self, ids: np.ndarray):
        self.x = ids
        with np.errstate(over="ignore"):
            steps = np.full(len(ids) + 1, 0xD1342543DE82EF95, np.uint64)
            steps[0] = 1
            self.power = np.cumprod(steps, dtype=np.uint64)
            values = mix(ids.astype(np.uint64) + np.uint64(1)) * self.power[:-1]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def same(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a equal the n words q further."""
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * self.power[q] == self.sums[a + q + n] - self.sums[a + q]

    def right(self, e: int, q: int, high: int) -> int:
        """The first position from e whose word differs from the one q before it."""
        step = 32
        while e < high:
            n = min(step, high - e)
            bad = np.flatnonzero(self.x[e : e + n] != self.x[e - q : e - q + n])
            if bad.size:
                return e + int(bad[0])
            e, step = e + n, step * 4
        return e

    def left(self, s: int, q: int, low: int) -> int:
        """The least position down from s from which on all words equal those q after them."""
        step = 32
        while s > low:
            n = min(step, s - low)
            bad = np.flatnonzero(self.x[s - n : s] != self.x[s - n + q : s + q])
            if bad.size:
                return s - n + int(bad[-1]) + 1
            s, step = s - n, step * 4
        return s


def crossing(words: Words, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, start, end, period) of the stretches within low and high that repeat often enough around the middle.

    Half of the words of a run lie on one side of the boundary, so a period is tried if two periods right or left of
    the boundary are equal. A period that is a multiple of a smaller one of the same words is skipped.
    """
    out: list[tuple[int, int, int, int]] = []
    whole = (high - low) // PERIODS
    sides = [(np.minimum(whole, (high - middle) // 2), True), (np.minimum(whole, (middle - low) // 2), False)]
    total = sides[0][0] + sides[1][0]
    nodes = np.flatnonzero((total > 0) & (high - low >= LEAST))
    cuts = np.searchsorted(np.cumsum(total[nodes]), np.arange(0, int(total[nodes].sum()) + 1, TESTS), side="right")
    cuts = np.unique(np.concatenate([[0], cuts, [len(nodes)]]))
    for i, j in zip(cuts[:-1], cuts[1:]):
        part = nodes[i:j]
        found = []
        for most, right in sides:
            m = most[part]
            node = np.repeat(part, m)
            q = np.arange(len(node)) - np.repeat(np.cumsum(m) - m, m) + 1
            b = middle[node]
            first = words.x[b] == words.x[b + q] if right else words.x[b - 1] == words.x[b - 1 - q]
            node, q = node[first], q[first]
            n = np.maximum(q, LEAST // 2 - q)  # one side has half of the words of a run
            good = (middle[node] + q + n <= high[node]) if right else (middle[node] - q - n >= low[node])
            node, q, n = node[good], q[good], n[good]
            good = words.same(middle[node] - (0 if right else q + n), q, n)
            found.append((node[good], q[good], np.full(int(good.sum()), right)))
        node, q, right = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((q, node))
        node, q, right = node[order], q[order], right[order]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else []
        for u, v in zip(start, np.append(start[1:], len(node)) if len(node) else []):
            n = int(node[u])
            lo, b, hi = int(low[n]), int(middle[n]), int(high[n])
            ps, rs = q[u:v], right[u:v]
            while len(ps):
                p = int(ps[0])
                if rs[0]:
                    s, e = words.left(b, p, lo), words.right(b + p, p, hi)
                    equal = e >= b + 2 * p
                else:
                    s, e = words.left(b - p, p, lo), words.right(b, p, hi)
                    equal = s <= b - 2 * p
                drop = np.zeros(len(ps), bool)
                drop[0] = True
                if equal:  # the sums were right
                    inside = np.where(rs, (b >= s) & (b + 2 * ps <= e), (b - 2 * ps >= s) & (b <= e))
                    drop |= inside & (ps % p == 0)
                    if e - s >= max(LEAST, PERIODS * p):
                        out.append((n, s, e, p))
                ps, rs = ps[~drop], rs[~drop]
    return out


def runs_of(ids: np.ndarray, symbols: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in the concatenated texts that end at `ends`, ordered by start and period. No two texts share an id."""
    nothing = np.empty(0, np.int64)
    if len(ids) < LEAST:
        return nothing, nothing, nothing
    g, words = Grammar(ids, symbols), Words(ids)
    big = np.flatnonzero((g.left >= 0) & (g.length >= LEAST))
    low, middle, high = tree(g.at, ends)
    mid = g.first[big] + g.length[g.left[big]]
    got = crossing(words, np.append(g.first[big], low), np.append(mid, middle), np.append(g.first[big] + g.length[big], high))
    if not got:
        return nothing, nothing, nothing
    node, start, end, period = np.array(got, np.int64).T
    top = node >= len(big)
    pieces = [(start[top], end[top], period[top])]
    if not top.all():
        of, start, end, period = big[node[~top]], start[~top], end[~top], period[~top]
        order = np.argsort(of, kind="stable")
        of, start, end, period = of[order], start[order] - g.first[of[order]], end[order] - g.first[of[order]], period[order]
        holds = np.zeros(len(g.left), bool)
        holds[of] = True
        for a, b in g.rounds:
            holds[a:b] |= holds[g.left[a:b]] | holds[g.right[a:b]]
        sym, pos = g.sequence[holds[g.sequence]], g.at[holds[g.sequence]]
        while len(sym):  # down the derivation, to every position of a nonterminal that holds a run
            a, b = np.searchsorted(of, sym), np.searchsorted(of, sym, side="right")
            many = b - a
            each = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shift = np.repeat(pos, many)
            pieces.append((start[each] + shift, end[each] + shift, period[each]))
            part = g.left[sym] >= 0
            sym, pos = sym[part], pos[part]
            sym, pos = np.append(g.left[sym], g.right[sym]), np.append(pos, pos + g.length[g.left[sym]])
            sym, pos = sym[holds[sym]], pos[holds[sym]]
    start, end, period = (np.concatenate(c) for c in zip(*pieces))
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    # the furthest end so far among the same period: what begins a period or more before it is the same run
    far = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * (len(ids) + 1)
    reach = np.maximum.accumulate(end + far) - far
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])])
    at = np.flatnonzero(new)
    start, end, period = start[at], reach[np.append(at[1:], len(new)) - 1], period[at]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def numbered(texts: Iterator[tuple[list[bytes], np.ndarray | None]]) -> tuple[np.ndarray, int, np.ndarray]:
    """Ids of the words of all texts in one array, how many there are, and where each text ends; each text's ids are its own."""
    parts, symbols, ends = [np.empty(0, np.int64)], 0, []
    at = 0
    for ws, order in texts:
        own: dict[bytes, int] = {}
        ids = np.fromiter((own.setdefault(w, len(own)) for w in ws), np.int64, len(ws)) + symbols
        parts.append(ids if order is None else ids[order])
        symbols, at = symbols + len(own), at + len(ws)
        ends.append(at)
    return np.concatenate(parts), symbols, np.array(ends, np.int64)


def periodic_runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per row of docs: ident, n_words, runs (start, length, period by start, then period) and collapsed.

    Words are what lies between the six white-space characters of ASCII, as they are. A run is a longest stretch with smallest
    period q that has LEAST words and PERIODS periods. collapsed is the text without the words that a run holds after its
    first period, joined by one space. order(id, number of words), if given, says which word stands at each place. Null and
    empty texts have no words; null and repeated ids and rows that repeat are rows of their own; other columns are not read;
    an empty table gives an empty one. Texts are whole, whatever their length. No row is shuffled.
    """
    kind = docs.schema[ident].dataType

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        names = part.column(0).to_pylist()
        texts = [(v.as_buffer().to_pybytes() if v.is_valid else b"").split() for v in part.column(1).cast(pa.binary())]
        orders = [order(i, len(ws)) if order else None for i, ws in zip(names, texts)]
        ids, symbols, ends = numbered(zip(texts, orders))
        start, end, period = runs_of(ids, symbols, ends)
        first = np.searchsorted(start, np.concatenate([[0], ends]))
        drop = np.zeros(len(ids) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, end, -1)
        drop = np.cumsum(drop) > 0
        collapsed, at = [], 0
        for k, (ws, o) in enumerate(zip(texts, orders)):
            if o is not None:
                ws = [ws[i] for i in o.tolist()]
            if first[k + 1] > first[k]:
                ws = [w for w, d in zip(ws, drop[at : at + len(ws)].tolist()) if not d]
            collapsed.append(b" ".join(ws))
            at = int(ends[k])
        begin = np.concatenate([[0], ends[:-1]])[np.searchsorted(ends, start, side="right")] if len(start) else start
        runs = pa.StructArray.from_arrays([pa.array(start - begin), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
        rows = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), runs)
        sizes = pa.array(np.diff(np.concatenate([[0], ends])))
        return pa.RecordBatch.from_arrays([part.column(0), sizes, rows, pa.array(collapsed, pa.binary()).cast(pa.string())], [ident, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(ident), F.col(text).cast("string").alias("_t"))
    return map_arrow(rows, fn, f"`{ident}` {kind.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length, of equals the one of smallest start, then period; null if there is none."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(key)


def digests(runs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The longest run of each document, how often it repeats in thousandths, and hashes of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = runs.withColumn("_b", longest(F.col("runs")))
    length = -F.col("_b.l")
    return best.select(
        ident,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_b.start").alias("start"),
        length.alias("length"),
        F.col("_b.period").alias("period"),
        F.floor(length * 1000 / F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
