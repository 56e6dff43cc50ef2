"""Packing of token ids into windows by lexical retrieval.

Documents are encoded, each with a closing id 0. Full windows of a long document stand alone; what is left of each
document is packed. The inverted index is cut into shards by what documents say: by the nearest of some pivot
documents, then by a MinHash that prefers rare terms, so that near copies and documents that share rare terms lie in one
shard at every size of the corpus. BM25 (document frequencies and lengths over the whole corpus, postings by shard)
ranks, for each seed, the unused documents of its shard; they fill the seed's window in that order, and the one that no
longer fits is cut and seeds the next window. The last ids of a shard are cut into sequences whose lengths are powers
of two, so nothing is padded.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import mix, ready, release, slices, written
from gable.llm.token_counts import UNCOMMON, PATTERN, load, one_piece, pre_tokens, ranks_of

#: Ids in a window; postings (distinct terms of documents) in a shard, on average; BM25's constants.
WINDOW, SHARD, K1, B = 1024, 250_000, 1.2, 0.75
#: A term that this share (1 of so many) of a shard's documents hold has a row of weights instead of postings; the scores are the same.
COMMON = 4
#: Documents (about, drawn by a hash of their text) from which pivots and the order of terms by rarity are taken, pivots, power of a term's rarity in the hash.
SAMPLE, PIVOTS, RARITY = 2000, 32, 4
#: Stretches between spaces whose ids a worker remembers.
REMEMBERED = 400_000
#: The pattern without its look ahead, which says the same, and faster, of texts in which no two white characters meet.
_SINGLE, _TWO_SPACES = PATTERN.replace(r"|\s+(?!\S)", ""), re.compile(r"\s\s").search
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts, equal to the tokenizers library's without added special tokens.

    Texts of common characters only, in which all libraries see the same pre-tokens, are merged whole by rank where merges
    rank as their ids do. In others, as a single space between two other characters begins a pre-token, texts without
    double spaces are taken apart at spaces first, and what stands between is encoded once while it is remembered.
    """

    def __init__(self, path: str):
        self.tok = load(path)
        self.added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65_536 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.chunks: dict[str, bytes] = {}
        self.ranks = ranks_of(path)
        if self.ranks is None:
            plain = load(path)
            plain.pre_tokenizer = one_piece()
            self.merge = lambda w: plain.encode(w, add_special_tokens=False).ids
        else:
            import tiktoken

            self.merge = tiktoken.Encoding("gable", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
            self.merge_single = tiktoken.Encoding("gable", pat_str=_SINGLE, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
            self.bytes = np.zeros(max(self.ranks.values()) + 1, np.int64)
            self.bytes[list(self.ranks.values())] = [len(t) for t in self.ranks]

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def chunk(self, text: str) -> bytes:
        words = pre_tokens(text)
        if words is None:
            return self.pack(self.tok.encode(text, add_special_tokens=False).ids)
        return b"".join([self.pack(self.merge(w)) for w in words])

    def learn(self, missing: set[str]) -> None:
        """Encode stretches that follow a space: many in one call, told apart by the bytes of their ids."""
        together = [c for c in missing if c and not UNCOMMON(c)] if self.ranks is not None else []
        for c in missing.difference(together):
            self.chunks[c] = self.chunk(" " + c)
        if together:
            ids = np.array(self.merge(" " + " ".join(together)), self.dtype)
            ends = np.cumsum([len(c) + 1 if c.isascii() else len(c.encode()) + 1 for c in together])
            at = (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1) * self.dtype.itemsize
            raw, begin = ids.tobytes(), 0
            for c, end in zip(together, at.tolist()):
                self.chunks[c] = raw[begin:end]
                begin = end

    def plain(self, text: str) -> bytes:
        """A text without special strings."""
        if self.ranks is not None and not UNCOMMON(text):
            return self.pack((self.merge if _TWO_SPACES(text) else self.merge_single)(text))
        if "  " in text:
            return self.chunk(text)
        head, *rest = text.split(" ")
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if missing := set(rest).difference(self.chunks):
            self.learn(missing)
        return self.chunk(head) + b"".join(map(self.chunks.__getitem__, rest))

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.special is not None and self.special.search(text):
            raw = b"".join(self.pack([self.added[p]]) if p in self.added else self.plain(p) for p in self.special.split(text))
        else:
            raw = self.plain(text)
        return np.frombuffer(raw + b"\0" * self.dtype.itemsize, self.dtype)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a worker; tasks forget their stretches at the end."""
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class ShardIndex:
    """BM25 over the documents of a shard: postings by term, weights ready."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float):
        n = np.array([len(t) for t in terms])
        doc, term = np.repeat(np.arange(len(terms)), n), np.concatenate(terms).astype(np.int64)
        tf = np.concatenate(counts).astype(np.float64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.vocab, first, self.size = np.unique(term[order], return_index=True, return_counts=True)
        self.first, self.terms, self.docs = first, terms, len(terms)
        common = np.flatnonzero(self.size * COMMON >= self.docs)  # as rows: a fourth at least of what these hold is not zero
        self.row, self.columns = np.full(len(self.vocab), -1), np.arange(self.docs)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.docs))
        for i, k in enumerate(common):
            part = slice(first[k], first[k] + self.size[k])
            self.rows[i, self.doc[part]] = self.weight[part]

    def only(self, wanted: np.ndarray) -> ShardIndex:
        """The same index without postings of other documents than those wanted, whose scores stay as they are."""
        out, keep = copy(self), wanted[self.doc]
        before = np.concatenate([[0], np.cumsum(keep)])
        out.doc, out.weight = self.doc[keep], self.weight[keep]
        some = wanted[self.columns]
        out.columns, out.rows = self.columns[some], self.rows[:, some]
        out.first, out.size = before[self.first], before[self.first + self.size] - before[self.first]
        return out

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of all documents for the terms of one."""
        at = np.searchsorted(self.vocab, self.terms[doc])
        row = self.row[at]
        common, at = row[row >= 0], at[row < 0]
        size = self.size[at]
        ends = np.cumsum(size)
        places = np.arange(size.sum()) + np.repeat(self.first[at] - ends + size, size)
        out = np.bincount(self.doc.take(places), self.weight.take(places), self.docs).astype(float, copy=False)
        out[self.columns] += self.rows[common].sum(axis=0)
        return out


def best_unused(scores: np.ndarray, used: np.ndarray, first: int = 48) -> Iterator[int]:
    """Unused documents from the best score on; most calls need a few, so only those are sorted first."""
    free = np.flatnonzero(~used)
    s = -scores[free]
    if len(free) > 2 * first:
        near = np.argpartition(s, first)
        head = np.sort(near[:first])
        yield from free[head[np.argsort(s[head], kind="stable")]].tolist()
        rest = np.sort(near[first:])
        free, s = free[rest], s[rest]
    yield from free[np.argsort(s, kind="stable")].tolist()


def fill(lengths: list[int], index: ShardIndex, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every id once; lengths are those left to pack, 0 for none."""
    used = np.array([x == 0 for x in lengths])
    out, seq, room, nxt = [], [], window, 0
    seed, at, held = -1, 0, len(lengths)
    while True:
        if seed < 0:
            while nxt < len(lengths) and used[nxt]:
                nxt += 1
            if nxt == len(lengths):
                break
            seed, at = nxt, 0
            used[seed] = True
        take = min(room, lengths[seed] - at)
        seq.append((seed, at, take))
        room -= take
        at += take
        last = seed if at < lengths[seed] else -1
        if room and (free := len(used) - int(np.count_nonzero(used))):
            if free < 0.9 * held:  # a posting of a used document is not read again
                index, held = index.only(~used), free
            for j in best_unused(index.scores(seed), used):
                used[j] = True
                take = min(room, lengths[j])
                seq.append((j, 0, take))
                room -= take
                if not room:
                    last, at = (j, take) if take < lengths[j] else (-1, 0)
                    break
        if not room:
            out.append(seq)
            seq, room = [], window
        seed = last
    if seq:  # the end of the shard: powers of two need no padding
        sizes = powers(window - room)
        part, left = [], sizes.pop(0)
        for d, s, n in seq:
            while n:
                take = min(n, left)
                part.append((d, s, take))
                s, n, left = s + take, n - take, left - take
                if not left:
                    out.append(part)
                    part, left = [], sizes.pop(0) if sizes else 0
    return out


class Sketch:
    """Where documents lie among others: the nearest pivot by the cosine of weighted terms, and a MinHash of the terms weighted by rarity."""

    def __init__(self, idf: np.ndarray, pivots: list[np.ndarray]):
        self.pivots = np.zeros((len(idf), max(1, len(pivots))), np.float32)
        for k, terms in enumerate(pivots):
            self.pivots[terms, k] = idf[terms] ** 2 / np.sqrt((idf[terms] ** 2).sum())
        with np.errstate(over="ignore"):
            u = ((mix(np.arange(1, len(idf) + 1, dtype=np.uint64)) >> np.uint64(11)) + np.uint64(1)) / 2.0**53
        self.order = -np.log(u) / np.maximum(idf, 0.01).astype(float) ** RARITY

    def __call__(self, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the pivot and the hash of each document; every document has a term."""
        starts = np.cumsum([0, *map(len, terms)])[:-1]
        flat = np.concatenate(terms)
        return np.argmax(np.add.reduceat(self.pivots[flat], starts), axis=1), np.minimum.reduceat(self.order[flat], starts)


def idf_of(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)


def frequencies(rows: DataFrame, vocab: int, dtype: np.dtype) -> np.ndarray:
    """How many rows hold each term, from their column terms."""

    def counted(batches):
        df = np.zeros(vocab, np.int64)
        for batch in batches:
            for t in batch.column("terms").to_pylist():
                df[np.frombuffer(t, dtype)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(vocab)
    for r in rows.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]  # bounded by the vocabulary
    return out


def sketch_of(docs: DataFrame, path: str, vocab: int, dtype: np.dtype) -> Sketch:
    """A sketch from a sample of docs (column _t)."""
    share = int(min(1.0, SAMPLE / max(1, docs.count())) * 1_000_000)

    def terms(batches):
        encode = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(encode(t)).tobytes() for t in batch.column("_t").to_pylist()], pa.binary())], names=["terms"])

    drawn = written(docs.where(F.pmod(F.xxhash64("_t"), F.lit(1_000_000)) < share).select("_t").mapInArrow(terms, "terms binary"))
    df = frequencies(drawn, vocab, dtype)
    pivots = drawn.where(F.length("terms") >= 20 * dtype.itemsize).dropDuplicates(["terms"]).orderBy(F.xxhash64("terms"), "terms").limit(PIVOTS).collect()
    return Sketch(idf_of(df, drawn.count()), [np.frombuffer(r["terms"], dtype).astype(np.int64) for r in pivots])


def packed(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: a byte-level BPE file of the tokenizers library, readable on every machine; ident is an integer column.
    A null text is empty and so has its closing id alone. Rows that repeat are packed each; null and repeated ids stay
    as they are. Other columns are not read; an empty table gives an empty one. Every id lies in one piece, and no
    sequence needs padding.

    A shard is a stretch of SHARD postings of the documents in the order of their sketch, so many equal documents fill
    several shards.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_t"))
    vocab = load(path).get_vocab_size()
    dtype = np.dtype("<u2") if vocab <= 65_536 else np.dtype("<u4")
    sketch = spark.sparkContext.broadcast(sketch_of(docs, path, vocab, dtype))

    def encoded(batches):
        encode = encoder(path)
        for whole in batches:
            for batch in slices(whole):
                rows = [encode(t) for t in batch.column("_t").to_pylist()]
                full = [[crc(ids[k : k + window]) for k in range(0, len(ids) - window + 1, window)] for ids in rows]
                tails = [ids[len(f) * window :].tobytes() for ids, f in zip(rows, full)]
                terms, counts = zip(*(np.unique(ids, return_counts=True) for ids in rows))
                pivot, rare = sketch.value(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id"),
                        pa.array([len(r) for r in rows], pa.int64()),
                        pa.array(full, pa.list_(pa.int64())),
                        pa.array(tails, pa.binary()),
                        pa.array([t.tobytes() for t in terms], pa.binary()),
                        pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary()),
                        pa.array([len(t) for t in terms], pa.int32()),
                        pa.array(pivot, pa.int32()),
                        pa.array(rare, pa.float64()),
                    ],
                    names=["doc_id", "doc_tokens", "full", "tail", "terms", "counts", "postings", "pivot", "rare"],
                )
        encode.chunks.clear()
        release()

    schema = "doc_id long, doc_tokens long, full array<long>, tail binary, terms binary, counts binary, postings int, pivot int, rare double"
    rows = written(docs.mapInArrow(encoded, schema))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_tokens").alias("tokens"), F.sum("postings").alias("postings")).first()
    idf = spark.sparkContext.broadcast(idf_of(frequencies(rows, vocab, dtype), total["n"]))
    mean = (total["tokens"] or 0) / max(1, total["n"])

    def fill_shard(table: pa.Table, seq: int) -> tuple[pa.RecordBatch, int]:
        ids, n, full = table["doc_id"].to_pylist(), table["doc_tokens"].to_pylist(), table["full"].to_pylist()
        tails = [np.frombuffer(t, dtype) for t in table["tail"].to_pylist()]
        index = ShardIndex([np.frombuffer(t, dtype) for t in table["terms"].to_pylist()], [np.frombuffer(c, "<u4") for c in table["counts"].to_pylist()], np.array(n, float), idf.value, mean)
        out: list[tuple] = []
        for d, f in enumerate(full):
            for k, c in enumerate(f):
                out.append((ids[d], k * window, window, c, n[d], seq, 0))
                seq += 1
        for pieces in fill([len(t) for t in tails], index, window):
            offset = 0
            for d, s, size in pieces:
                out.append((ids[d], len(full[d]) * window + s, size, crc(tails[d][s : s + size]), n[d], seq, offset))
                offset += size
            seq += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in PIECES.split(", ")]), seq

    def filled(batches):
        seq, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in slices(whole):
                ends = np.cumsum(batch.column("postings").to_numpy()) + size
                at = 0
                while (k := int(np.searchsorted(ends, SHARD))) < batch.num_rows:
                    held.append(batch.slice(at, k + 1 - at))
                    out, seq = fill_shard(pa.Table.from_batches(held), seq)
                    yield out
                    at, held, ends = k + 1, [], ends - ends[k]
                size = int(ends[-1])
                if at < batch.num_rows:
                    held.append(batch.slice(at))
        if held:
            yield fill_shard(pa.Table.from_batches(held), seq)[0]
        release()

    tie = F.xxhash64("doc_id", "doc_tokens")
    parts = max(1, (total["postings"] or 0) // (4 * SHARD))
    return rows.withColumn("_tie", tie).repartitionByRange(parts, "pivot", "rare", "_tie").sortWithinPartitions("pivot", "rare", "_tie", "doc_id", "doc_tokens").drop("_tie").mapInArrow(filled, PIECES)
