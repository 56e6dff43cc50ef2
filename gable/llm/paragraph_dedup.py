"""Repeated passages across documents: paragraph MinHash banding, exact Jaccard, connected components.

Passages are pasted into the middle of lines, so line breaks do not line up between documents. A paragraph is
therefore a stretch of words between cuts that the words themselves place: a cut stands where the hash of three words
is least within RADIUS places on both sides, so pasted text is cut alike wherever it stands. A paragraph's set holds the
five-word shingles that begin in it.

Each of three MinHash values of a paragraph is a band by itself, and so a shingle at a known place. Paragraphs that
collide in a band are seeds: each is held against the first paragraph of its band (smallest id, then place). Seeds of
two documents that lie close together and alike make a candidate. Both texts around a candidate are fetched and aligned
word by word, across short differences and out to where the agreement ends, and the pair is a link if the shingles of
the whole aligned passages have a Jaccard similarity of 0.8 or more and both have LEAST_WORDS words or more. The later
one of a link goes. Linked passages that overlap in a document are one node; components of nodes are the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import SHINGLE, SIMILAR, MinHash, by_group, fresh, grams, map_arrow, mix, ready, release, row_hash, word_hashes, words_of, written
from gable.llm.components import connected_components

#: Places on both sides of a cut; bands of one MinHash value each; words that a repeated passage must have.
RADIUS, BANDS, LEAST_WORDS = 5, 3, 18
#: Words between two seeds that may belong together, how far their distances may differ, words fetched around a candidate.
REACH, SLACK = 64, 8
#: Words in a row that may differ inside a passage, and stretches of agreement that are looked at together.
GAP, RUNS = 16, 1024
#: Places of fetched text on the side of the first paragraph are rounded to it, so that candidates share what they fetch.
GRID = 64
_LAST = 2**63 - 1


class Paragraphs:
    """Paragraphs of a batch of texts, in one array each: doc (place in the batch), start (in words), bounds of shingles."""

    def __init__(self, texts: list[str | None], radius: int = RADIUS):
        flat, starts = word_hashes(texts)
        n = len(flat)
        size = np.diff(starts)
        doc = np.repeat(np.arange(len(size)), size)
        left = np.arange(n) - starts[:-1][doc] if n else np.empty(0, int)  # words before, in the document
        right = size[doc] - left - 1 if n else left
        three = grams(flat, 3)
        cut = (right >= 2) & (left > 0) if n else np.empty(0, bool)
        for k in range(1, radius + 1):
            if k < n:
                cut[k:] &= (three[k:] < three[:-k]) | (left[k:] < k)
                cut[:-k] &= (three[:-k] <= three[k:]) | (right[:-k] < k + 2)
        five = grams(flat, SHINGLE)
        ok = right >= SHINGLE - 1
        cut &= ok
        cut[starts[:-1][size > 0]] = True  # a document begins a paragraph
        place = np.flatnonzero(ok)
        first = np.flatnonzero(cut & ok)
        self.shingles = five[place]
        self.begin = np.searchsorted(place, first)
        self.count = np.diff(np.append(self.begin, len(place)))
        self.doc, self.start = doc[first], left[first]

    def bands(self, k: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, doc and place (in words) of the least shingle of each paragraph by k hashes; a shingle once a paragraph."""
        if not len(self.begin):
            return np.empty(0, np.int64), np.empty(0, int), np.empty(0, int)
        own = np.repeat(np.arange(len(self.begin)), self.count)
        found = []
        for b in MinHash(8, 11).b[:k]:
            h = mix(self.shingles ^ b)
            at = np.flatnonzero(h == np.minimum.reduceat(h, self.begin)[own])
            found.append(at[np.append(True, own[at][1:] != own[at][:-1])])
        # a paragraph without a cut for long, as one word repeated, has further seeds
        step = np.arange(len(own)) - self.begin[own]
        found.append(np.flatnonzero((self.count[own] > REACH) & (step % (REACH // 2) == 0)))
        at = np.unique(np.concatenate(found))
        return self.shingles[at].view(np.int64), self.doc[own[at]], self.start[own[at]] + at - self.begin[own[at]]


_LEAD = np.dtype([("doc", "<i8"), ("rp", "<i8")])


def _seeds(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(key, doc, rp, lead) of each seed. rp: 31 bits of the row's hash, then the place. A key that repeats in the batch
    goes on once; its further seeds have their lead already and travel under a key of their own."""
    key, d, place = Paragraphs(batch.column("_t").to_pylist()).bands()
    if not len(key):
        return None
    doc = batch.column("doc").to_numpy(zero_copy_only=False)[d]
    rp = (batch.column("r").to_numpy(zero_copy_only=False)[d] >> np.int64(33) << np.int64(32)) | place
    order = np.lexsort((rp, doc, key))
    key, doc, rp = key[order], doc[order], rp[order]
    group = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(group)[np.cumsum(group) - 1]
    lead = np.empty(len(key), _LEAD)
    lead["doc"], lead["rp"] = doc[first], rp[first]
    more = np.flatnonzero(~group)
    with np.errstate(over="ignore"):
        key[more] = mix(rp[more].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc[more].view(np.uint64)).view(np.int64)
    raw = [None] * len(key)
    for i in more.tolist():
        raw[i] = lead[i].tobytes()
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(rp), pa.array(raw, pa.binary())], names=["key", "doc", "rp", "lead"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of seeds with the first seed of their key, from rows sorted by key, doc and rp; one row is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.filter(batch.column("lead").is_valid())
        if known.num_rows:
            lead = np.frombuffer(b"".join(known.column("lead").to_pylist()), _LEAD)
            yield pa.RecordBatch.from_arrays([known.column("doc"), known.column("rp"), pa.array(lead["doc"]), pa.array(lead["rp"])], names=["doc", "rp", "ldoc", "lrp"])
        rest = batch.filter(batch.column("lead").is_null())
        if not rest.num_rows:
            continue
        key, doc, rp = (rest.column(x).to_numpy() for x in ("key", "doc", "rp"))
        if held is not None:
            key, doc, rp = (np.append(a, x) for a, x in zip(held, (key, doc, rp)))
        group = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(group)[np.cumsum(group) - 1]
        at = np.flatnonzero(~group)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], rp[at], doc[first[at]], rp[first[at]])], names=["doc", "rp", "ldoc", "lrp"])
        f = first[-1:]
        held = key[f], doc[f], rp[f]
    release()


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates from links sorted by doc, row, ldoc, lrow and place: seeds near each other, whole documents' pairs at a time."""
    names = ["doc", "r", "ldoc", "lr", "place", "lplace"]

    def emit(c: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        pair = np.cumsum(np.append(True, np.any([c[x][1:] != c[x][:-1] for x in names[:4]], axis=0)))
        diag = c["lplace"] - c["place"]
        backed = np.zeros(len(pair), bool)
        for k in (1, 2, 3):  # another seed near by: rows are sorted by place
            if len(pair) > k:
                near = (pair[k:] == pair[:-k]) & (c["place"][k:] > c["place"][:-k]) & (c["place"][k:] - c["place"][:-k] <= REACH)
                near &= (np.abs(diag[k:] - diag[:-k]) <= SLACK) | (c["lplace"][k:] == c["lplace"][:-k])
                backed[k:] |= near
                backed[:-k] |= near
        at = np.flatnonzero(backed)
        at = at[np.lexsort((c["place"][at], diag[at], pair[at]))]
        if not len(at):
            return None
        new = np.append(True, (pair[at][1:] != pair[at][:-1]) | (diag[at][1:] != diag[at][:-1]) | (c["place"][at][1:] - c["place"][at][:-1] > REACH))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        out = [c[x][at[first]] for x in names] + [c["place"][at[last]]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[*names, "last"])

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, rp, ldoc, lrp = (batch.column(x).to_numpy() for x in ("doc", "rp", "ldoc", "lrp"))
        low = np.int64(0xFFFFFFFF)
        c = {"doc": doc, "r": rp >> np.int64(32), "ldoc": ldoc, "lr": lrp >> np.int64(32), "place": rp & low, "lplace": lrp & low}
        if held is not None:
            c = {x: np.concatenate([held[x], c[x]]) for x in names}
        change = np.flatnonzero(np.any([c[x][1:] != c[x][:-1] for x in names[:4]], axis=0))
        keep = int(change[-1]) + 1 if len(change) else 0
        done, held = {x: v[:keep] for x, v in c.items()}, {x: v[keep:] for x, v in c.items()}
        if keep and (out := emit(done)) is not None:
            yield out
    if held is not None and (out := emit(held)) is not None:
        yield out


def candidates(docs: DataFrame) -> DataFrame:
    """(doc, r, place, last, ldoc, lr, lplace): seeds at places from place to last of a document that agree with those of an earlier one from lplace on.

    docs has doc (ids, the largest number for null), r (64-bit hash of the row) and _t; r and lr of the result are 31 bits of it.
    """
    ready(docs.sparkSession)
    seeds = map_arrow(docs, _seeds, "key long, doc long, rp long, lead binary")
    links = seeds.repartition("key").sortWithinPartitions("key", "doc", "rp").mapInArrow(_led, "doc long, rp long, ldoc long, lrp long")
    # no link of a seed with one that overlaps it
    links = written(links.where("doc != ldoc or shiftright(rp, 32) != shiftright(lrp, 32) or (rp & 4294967295) - (lrp & 4294967295) >= 5"))
    row = [F.shiftright("rp", 32).alias("_a"), F.shiftright("lrp", 32).alias("_b")]
    links = links.select("*", *row).repartition("doc", "_a", "ldoc", "_b").sortWithinPartitions("doc", "_a", "ldoc", "_b", "rp").drop("_a", "_b")
    return links.mapInArrow(_chains, "doc long, r long, ldoc long, lr long, place long, lplace long, last long")


def _numbered(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Numbers of the words (between single blanks) and of the shingles of each text, equal exactly where the words are."""
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = split.offsets.to_numpy()
    five = np.empty(0, np.int64)
    if len(words) >= SHINGLE:
        size = int(words.max()) + 1
        two = np.unique(words[:-1] * size + words[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * len(two) + two[2:], return_inverse=True)[1]
        five = np.unique(four[:-1] * size + words[SHINGLE - 1 :], return_inverse=True)[1]
    bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
    return [words[s:e] for s, e in bounds], [five[s : max(s, e - SHINGLE + 1)] for s, e in bounds]


def _runs(wa: np.ndarray, wb: np.ndarray, ga: np.ndarray, gb: np.ndarray, diag: int) -> list[tuple[int, int, int, int]]:
    """Stretches of equal shingles near the diagonal, rising in both lists: first and last shingle in a, in b."""
    places = np.argsort(gb, kind="stable")
    rising = gb[places]
    low, high = rising.searchsorted(ga), rising.searchsorted(ga, side="right")
    shared = np.flatnonzero(low < high)
    runs: list[tuple[int, int, int, int]] = []
    k = 0
    while k < len(shared):
        i = int(shared[k])
        k += 1
        want = i + (runs[-1][3] - runs[-1][1] if runs and i - runs[-1][1] <= REACH else diag)
        at = places[low[i] : high[i]]
        if len(at) > 1:
            m = int(at.searchsorted(want))
            at = at[max(0, m - 1) : m + 1]
        j = int(at[0] if len(at) == 1 or want - at[0] <= at[1] - want else at[1])
        if abs(j - want) > 2 * SLACK or (runs and j <= runs[-1][3]):
            continue
        n = min(len(wa) - i, len(wb) - j)
        other = wa[i : i + n] != wb[j : j + n]
        same = int(other.argmax()) if other.any() else n
        runs.append((i, i + same - SHINGLE, j, j + same - SHINGLE))
        k = int(shared.searchsorted(runs[-1][1] + 1))
    return runs


def _before(g: np.ndarray) -> np.ndarray:
    """For each place the last one before it that holds the same number, -1 where there is none."""
    order = np.argsort(g, kind="stable")
    out = np.full(len(g), -1)
    again = np.flatnonzero(g[order][1:] == g[order][:-1])
    out[order[again + 1]] = order[again]
    return out


def _alike(block: list[tuple[int, int, int, int]], ga: np.ndarray, gb: np.ndarray, threshold: float, least: int) -> list[tuple[int, int, int, int]]:
    """The longest of consecutive runs whose whole shingle sets reach the threshold, then the longest of what is left, and so on.

    For each first run, one pass over the shingles tells the sizes of both sets and what they share up to each last run.
    """
    r = np.array(block)
    n, base, lbase = len(r), int(r[0, 0]), int(r[0, 2])
    ga, gb = ga[base : r[-1, 1] + 1], gb[lbase : r[-1, 3] + 1]
    r = r - np.array([base, base, lbase, lbase])
    known, number = np.unique(np.append(ga, gb), return_inverse=True)
    ga, gb, size = number[: len(ga)], number[len(ga) :], len(known)
    sides = [(g, _before(g), np.searchsorted(ends, np.arange(len(g)))) for g, ends in ((ga, r[:, 1]), (gb, r[:, 3]))]
    found = []
    for x in range(n):
        since, counts = [], []
        for (g, before, run), begin in zip(sides, (r[x, 0], r[x, 2])):
            first = begin + np.flatnonzero(before[begin:] < begin)
            at = np.full(size, n)
            at[g[first]] = run[first]
            since.append(at)
            counts.append(np.cumsum(np.bincount(run[first], minlength=n)))
        both = np.cumsum(np.bincount(np.maximum(*since), minlength=n + 1)[:n])
        fits = both >= threshold * (counts[0] + counts[1] - both) - 1e-9
        fits &= np.minimum(r[:, 1] - r[x, 0], r[:, 3] - r[x, 2]) + SHINGLE >= least
        fits[:x] = False
        found += [(x, y) for y in np.flatnonzero(fits).tolist()]
        if x == 0 and fits[-1]:
            break
    taken = np.zeros(n, bool)
    out = []
    for x, y in sorted(found, key=lambda w: r[w[0], 0] - r[w[1], 1]):
        if not taken[x : y + 1].any():
            taken[x : y + 1] = True
            out.append((base + int(r[x, 0]), base + int(r[y, 1]) + SHINGLE, lbase + int(r[x, 2]), lbase + int(r[y, 3]) + SHINGLE))
    return out


def _aligned(wa: np.ndarray, wb: np.ndarray, ga: np.ndarray, gb: np.ndarray, diag: int, threshold: float = SIMILAR, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """Similar passages of texts a and b, as numbers of their words and shingles, near the diagonal (place in b less place in a).

    A passage is its start and end in a, then in b. Stretches of equal words are joined across at most GAP differing words.
    Of the stretches so joined, the longest run whose whole shingle sets reach the threshold is a passage, then what is left
    on both sides of it.
    """
    n = SHINGLE
    if min(len(wa), len(wb)) < max(n, least):
        return []
    blocks: list[list[tuple[int, int, int, int]]] = []
    for r in _runs(wa, wb, ga, gb, diag):
        near = blocks and r[0] - blocks[-1][-1][1] - n <= GAP and r[2] - blocks[-1][-1][3] - n <= GAP and len(blocks[-1]) < RUNS
        if near:
            blocks[-1].append(r)
        else:
            blocks.append([r])
    out = []
    for block in blocks:
        if block[-1][1] + n - block[0][0] < least or block[-1][3] + n - block[0][2] < least:
            continue
        if len(block) == 1:  # equal words
            out.append((block[0][0], block[0][1] + n, block[0][2], block[0][3] + n))
        else:
            out += _alike(block, ga, gb, threshold, least)
    return out


def aligned(a: list[str], b: list[str], diag: int, threshold: float = SIMILAR, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """_aligned for two lists of words without blanks."""
    (wa, wb), (ga, gb) = _numbered(pa.array([" ".join(a), " ".join(b)]))
    return _aligned(wa, wb, ga, gb, diag, threshold, least)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def similar_passages(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    """(doc, r, s, e, ldoc, lr, ls, le): words s to e of a row are similar to words ls to le of an earlier row, or of its own before s."""
    found = candidates(rows)
    start, end = F.greatest(F.col("place") - REACH, F.lit(0)), F.col("last") + SHINGLE + REACH
    shift = F.col("lplace") - F.col("place")
    low, high = F.floor(F.greatest(F.col("lplace") - REACH, F.lit(0)) / GRID) * GRID, F.ceil((end + shift) / GRID) * GRID
    found = written(found.select("doc", "r", start.alias("s"), end.alias("e"), "ldoc", "lr", low.alias("ls"), high.alias("le"), shift.alias("diag")))
    # what to fetch: bounded by the length of the row, however many ask for it
    asked = found.select("doc", "r", F.lit(True).alias("own"), "s", "e", "ldoc", "lr", "ls", "le", "diag").unionByName(
        found.select(F.col("ldoc").alias("doc"), F.col("lr").alias("r"), F.lit(False).alias("own"), F.col("ls").alias("s"), F.col("le").alias("e")).distinct(), allowMissingColumns=True
    )
    asked = asked.groupBy("doc", "r").agg(F.collect_list(F.struct("own", "s", "e", "ldoc", "lr", "ls", "le", "diag")).alias("asked")).withColumnsRenamed({"doc": "_d", "r": "_r"})
    both = rows.join(asked.hint("merge"), (F.col("doc") == F.col("_d")) & (F.shiftright("r", 33) == F.col("_r"))).select("doc", "r", "_t", "asked")
    kind = "doc long, r long, own boolean, s long, ldoc long, lr long, ls long, le long, diag long, words string"

    def fetched(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, r, t, asks in zip(*(batch.column(x).to_pylist() for x in ("doc", "r", "_t", "asked"))):
            words = words_of(t)
            for q in asks:
                piece = " ".join(words[q["s"] : q["e"]])
                out.append((doc, r, True, q["s"], q["ldoc"], q["lr"], q["ls"], q["le"], q["diag"], piece) if q["own"] else (doc, r, False, q["s"], doc, r >> 33, q["s"], q["e"], None, piece))
        cols = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=[x.split()[0] for x in kind.split(", ")])

    pieces = written(map_arrow(both, fetched, kind))
    there = pieces.where("not own").select("ldoc", "lr", "ls", "le", F.col("r").alias("lrow"), F.col("words").alias("lwords")).dropDuplicates(["ldoc", "lr", "ls", "le", "lrow"])
    here = pieces.where("own").select("doc", "r", "s", "ldoc", "lr", "ls", "le", "diag", "words")
    pairs = here.join(there.hint("merge"), ["ldoc", "lr", "ls", "le"])

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        both = pa.concat_arrays([batch.column("words"), batch.column("lwords")]).dictionary_encode()  # copies share their texts
        words, grams = _numbered(both.dictionary)
        text = both.indices.to_pylist()
        seen: dict[tuple[int, int, int], list[tuple[int, int, int, int]]] = {}
        out = []
        for k, (doc, r, s, ldoc, lrow, ls, diag) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("doc", "r", "s", "ldoc", "lrow", "ls", "diag")))):
            a, b = text[k], text[k + batch.num_rows]
            key = a, b, diag + s - ls
            if key not in seen:
                seen[key] = _aligned(words[a], words[b], grams[a], grams[b], key[2], threshold, least)
            for x, y, lx, ly in seen[key]:
                one, two = (doc, r, s + x, s + y), (ldoc, lrow, ls + lx, ls + ly)
                if one[:2] != two[:2] or one[2] >= two[3] or two[2] >= one[3]:
                    out.append((*max(one, two), *min(one, two)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "r", "s", "e", "ldoc", "lr", "ls", "le"]) if out else None

    return written(map_arrow(pairs, compared, "doc long, r long, s long, e long, ldoc long, lr long, ls long, le long").distinct())


def _repeated(docs: DataFrame, ident: str, text: str, threshold: float, least: int) -> DataFrame:
    """(doc, r, start_word, n_words, class_doc, class_start, removed); r is the row_hash of the row."""
    rows = docs.select(F.coalesce(F.col(ident).cast("long"), F.lit(_LAST)).alias("doc"), row_hash(ident, text).alias("r"), F.col(text).alias("_t"))
    links = similar_passages(rows, threshold, least)
    ends = links.select("doc", "r", "s", "e").unionByName(links.select(F.col("ldoc").alias("doc"), F.col("lr").alias("r"), F.col("ls").alias("s"), F.col("le").alias("e"))).distinct()

    def nodes(table: pa.Table) -> dict:
        spans = list(zip(table["s"].to_pylist(), table["e"].to_pylist()))
        whole = _merged(spans)
        at = np.searchsorted([s for s, _ in whole], [s for s, _ in spans], side="right") - 1
        return {"doc": table["doc"].to_pylist(), "r": table["r"].to_pylist(), "s": [s for s, _ in spans], "e": [e for _, e in spans], "node_start": [whole[k][0] for k in at]}

    node = F.xxhash64("doc", "r", "node_start")
    ends = written(by_group(ends, ["doc", "r"], nodes, "doc long, r long, s long, e long, node_start long").withColumn("node", node))
    first = links.join(ends.hint("merge"), ["doc", "r", "s", "e"]).select("ldoc", "lr", "ls", "le", F.col("node").alias("a"))
    there = ends.select(F.col("doc").alias("ldoc"), F.col("r").alias("lr"), F.col("s").alias("ls"), F.col("e").alias("le"), F.col("node").alias("b"))
    joined = connected_components(first.join(there.hint("merge"), ["ldoc", "lr", "ls", "le"]).select("a", "b").distinct())
    known = ends.select("doc", "r", "node_start", "node").distinct().join(joined.withColumnRenamed("id", "node").hint("merge"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    least_of = F.struct("doc", "r", "node_start")
    classes = known.groupBy("c").agg(F.min(least_of).alias("first"), F.max(F.struct("doc", "r")).alias("last")).where("first.doc != last.doc or first.r != last.r")
    known = known.join(written(classes).hint("merge"), "c").select("node", F.col("first.doc").alias("class_doc"), F.col("first.node_start").alias("class_start"))
    later = links.select("doc", "r", "s", "e").distinct().withColumn("later", F.lit(True))
    spans = ends.join(later.hint("merge"), ["doc", "r", "s", "e"], "left").join(known.hint("merge"), "node").select("doc", "r", "s", "e", F.coalesce("later", F.lit(False)).alias("later"), "class_doc", "class_start")

    def told(table: pa.Table) -> dict:
        each = table.select(["s", "e", "later", "class_doc", "class_start"]).to_pylist()
        gone = _merged([(x["s"], x["e"]) for x in each if x["later"]])
        stay = [(s, e) for s, e in _merged([(x["s"], x["e"]) for x in each if not x["later"]]) if not any(a < e and s < b for a, b in gone)]
        of = {}
        for x in sorted(each, key=lambda x: -x["s"]):
            of[x["s"]] = x["class_doc"], x["class_start"]
        out = [(s, e - s, *of[s], removed) for part, removed in ((gone, True), (stay, False)) for s, e in part]
        return {"doc": [table["doc"][0].as_py()] * len(out), "r": [table["r"][0].as_py()] * len(out), **{x: [o[k] for o in out] for k, x in enumerate(("start_word", "n_words", "class_doc", "class_start", "removed"))}}

    return by_group(spans, ["doc", "r"], told, "doc long, r long, start_word long, n_words long, class_doc long, class_start long, removed boolean")


def repeated_passages(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = SIMILAR, least: int = LEAST_WORDS) -> DataFrame:
    """One row per repeated passage in a document: ident, start_word, n_words, class_doc_id, class_start, removed.

    Words are counted between white space and compared in lower case. A passage of `least` words or more is repeated if
    one in another document is similar to it: the Jaccard similarity of their sets of five-word shingles is `threshold`
    or more. Of two similar passages the later one is removed (by id, null after all others, then by a hash of the row,
    then by place). Rows with removed false are the passages that removed ones were held against, so far as they stay.
    class_doc_id and class_start tell where the first passage of the class stands (null: a null id).

    Texts that are null, empty or shorter than `least` words hold no passage; repetitions within one row alone do not
    count. Ids are integers or null; rows that share an id are told apart by their texts, and rows that repeat id and text count
    as one. Other columns are not read; an empty table gives an empty one.
    """
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    out = _repeated(docs, ident, text, threshold, least)
    return out.select(back("doc").alias(ident), "start_word", "n_words", back("class_doc").alias("class_doc_id"), "class_start", "removed")


def without_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: str | None = None, threshold: float = SIMILAR, least: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated passages cut out of the text, all rows and columns kept; `length` names a column of characters to set anew.

    See repeated_passages. A document that loses all its words stays, with an empty text. Documents without a repeated
    passage, null and empty texts stay as they are. Columns may have any names.
    """
    cut, spans, row = fresh(docs, "cut", "spans", "row")
    cuts = _repeated(docs, ident, text, threshold, least).where("removed")
    cuts = cuts.groupBy(F.col("r").alias(cut)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(spans))
    both = docs.withColumn(row, row_hash(ident, text)).join(cuts.hint("merge"), F.col(row) == F.col(cut), "left").drop(cut, row)
    names = docs.columns
    word = re.compile(r"\S+")

    def cleaned(t: str | None, spans: list | None) -> str | None:
        if not t or not spans:
            return t
        at = [(m.start(), m.end()) for m in word.finditer(t)]
        out, place = [], 0
        for s in sorted(spans, key=lambda x: x["start_word"]):
            begin, end = at[s["start_word"]][0], at[s["start_word"] + s["n_words"] - 1][1]
            out.append(t[place : max(place, begin)])
            place = max(place, end)
        return "".join([*out, t[place:]])

    def applied(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column(len(names)).to_pylist()
        k = names.index(text)
        texts = [cleaned(t, s) for t, s in zip(batch.column(k).to_pylist(), spans)]
        cols = [batch.column(i) for i in range(len(names))]
        cols[k] = pa.array(texts, cols[k].type)
        if length in names:
            q = names.index(length)
            old = cols[q].to_pylist()
            cols[q] = pa.array([len(t) if s and t is not None else o for t, s, o in zip(texts, spans, old)], cols[q].type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(both, applied, docs.schema)
