"""Byte-level BPE with Spark's higher-order functions: no Python reads a text.

Distinct words are folded: a word's bytes become token ids, and each step merges, from left to right, all neighbours
whose pair ranks lowest in a literal map, until no pair has a rank. A word is first taken apart where no token of the
vocabulary holds the two bytes side by side, for no merge can cross such a place; so even one word of a
hundred thousand letters costs little.

The most frequent words of a bounded sample are distinct words folded once, kept in a second literal map; all others, the
long tail, are folded where they stand, so the sample changes the time only and texts are not shuffled. (Folding the tail
by distinct words too, with a join back, was built and measured: see the README.) Decoding concatenates the binary
pieces of the ids.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.llm.common import written

#: Documents (about, drawn by a hash of their text) whose words are counted for the literal map of words, words in it, and buckets of the two maps.
SAMPLE, WORDS, BUCKETS = 20_000, 65_536, 65_536
#: Ids in a stretch from which all pairs of a rank that come next are merged in one step, not one by one; the ids are the same.
LONG = 48
_NONE = 2**31 - 1
#: Bits of an id, a place or a rank in the packed numbers of short words.
_BITS = 20
_MASK = 2**_BITS - 1
_FIELDS = "spark.sql.debug.maxToStringFields"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pattern_for_java(pattern: str) -> str:
    """The published pattern with white space as Unicode defines it, for Java's regular expressions."""
    return "(?U)" + pattern


def _literal(value, kind: str) -> Column:
    """A constant of any type, from a Python value or its JSON; Spark folds it into the plan once."""
    return F.from_json(F.lit(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)), kind)


def _bucket(number: Column) -> Column:
    return number.bitwiseAND(BUCKETS - 1).cast("int")


def _by_bucket(keys: array, values: array) -> str:
    """JSON of an array of small maps from keys to values, by bucket."""
    number, value = np.frombuffer(keys, np.int64), np.frombuffer(values, np.int64)
    bucket = number & (BUCKETS - 1)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    of = lambda at: ",".join(f'"{k}":{v}' for k, v in zip(number[at].tolist(), value[at].tolist()))
    return f"[{','.join('{' + of(order[a:b]) + '}' for a, b in zip(starts[:-1], starts[1:]))}]"


@contextmanager
def _unprinted(spark: SparkSession) -> Iterator[None]:
    """Plans that start meanwhile are described without their expressions.

    The driver keeps the description of every plan it ran, a literal of megabytes in it included, once a node that names it.
    """
    before = spark.conf.get(_FIELDS)
    spark.conf.set(_FIELDS, "0")
    try:
        yield
    finally:
        spark.conf.set(_FIELDS, before)


class Vocabulary:
    """Literals of a vocabulary: ids of single bytes, ranks of pairs of ids, bytes that may be neighbours; bytes and little-endian ids by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = size = max(ranks.values()) + 1
        keys, made = array("q"), array("q")  # flat numbers: as Python objects they would take the driver's memory
        beside = [False] * 65_536
        pieces = [""] * size
        for t, r in ranks.items():
            pieces[r] = t.decode("latin-1")
            for k in range(1, len(t)):
                beside[t[k - 1] * 256 + t[k]] = True
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * (size + 1) + b)  # size itself is no id and stands for the ends of a word
                    made.append(r)
        single = [ranks[bytes([b])] for b in range(256)]
        beginnings = [ranks.get(bytes([a, b]), _MASK) << 2 * _BITS | single[a] for a in range(256) for b in range(256)]
        self.fold = F.struct(
            _literal(single, "array<int>").alias("bytes"),
            _literal(beginnings, "array<bigint>").alias("beginnings"),
            _literal(_by_bucket(keys, made), "array<map<string,int>>").cast("array<map<bigint,int>>").alias("pairs"),
            _literal(beside, "array<boolean>").alias("beside"),
        )
        numbers = [i.to_bytes(4, "little").decode("latin-1") for i in range(size)]
        self.marks = list(zip(numbers, pieces))

    @property
    def pieces(self) -> Column:
        return _literal([p for _, p in self.marks], "array<string>")

    @property
    def numbers(self) -> Column:
        return _literal([n for n, _ in self.marks], "array<string>")

    @property
    def both(self) -> Column:
        return _literal(f"[{','.join(json.dumps({'n': n, 'p': p}, ensure_ascii=False) for n, p in self.marks)}]", "array<struct<n:string,p:string>>")


def bound(constant: Column, use: Callable[[Column], Column]) -> Column:
    """use(constant), the constant standing in the plan once however often it is used."""
    return F.transform(F.array(constant), lambda c: use(c))[0]


def _bytes_of(word: Column) -> Column:
    """array<int>; every character of the decoded word stands for one byte."""
    return F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda x: F.ascii(x))


def fold(c: Column, word: Column, size: int) -> Column:
    """Ids of one pre-token: array<int>. c: Vocabulary.fold, bound; size: the vocabulary's."""
    if size >= _MASK:
        return fold_long(c, word, size)
    return F.when(F.octet_length(word) < LONG, F.transform(fold_short(c, word, size), lambda x: x.bitwiseAND(_MASK).cast("int"))).otherwise(fold_long(c, word, size))


def fold_short(c: Column, word: Column, size: int) -> Column:
    """Ids of one pre-token of some bytes, in the lowest _BITS of each number.

    One number for an id, the place of its first byte and the rank of it and the next id, the highest bits: the least number is
    the pair to merge, the leftmost of its rank. Numbers before the first and after the last id, of rank _MASK (none), spare questions for the ends.
    """
    shift = lambda x, n: F.shiftleft(x, n * _BITS)
    none, edge = F.lit(_MASK << 2 * _BITS), F.array(F.lit(_MASK << 2 * _BITS | size))
    few = lambda e, begin, count: F.slice(e, begin, count)

    def high(key: Column) -> Column:
        return F.coalesce(shift(F.try_element_at(c["pairs"][_bucket(key)], key).cast("long"), 2), none)

    def merged(e: Column, least: Column) -> Column:
        low = F.shiftright(least, 2 * _BITS)

        def at(k: Column) -> Column:  # place of the left one of the pair, from 1
            left = F.get(e, k - 2)
            new_left = high(left.bitwiseAND(_MASK) * (size + 1) + low) + left.bitwiseAND(2 ** (2 * _BITS) - 1)
            new = high(low * (size + 1) + F.get(e, k + 1).bitwiseAND(_MASK)) + least.bitwiseAND(_MASK << _BITS) + low
            return F.flatten(F.array(few(e, F.lit(1), k - 2), F.array(new_left, new), few(e, k + 2, F.lit(2 * LONG))))  # quicker than concat, for which Spark builds a lazy list

        return bound(F.array_position(e, least).cast("int"), at)

    step = lambda e, _: bound(F.array_min(e), lambda least: F.when(least >= none, e).otherwise(merged(e, least)))
    last = lambda x: none + c["bytes"][x]
    begin = lambda b: F.concat(edge, F.transform(b, lambda x, i: F.coalesce(c["beginnings"][x * 256 + F.get(b, i + 1)], last(x)) + shift(i.cast("long"), 1)), edge)
    steps = lambda b: F.slice(b, 2, F.lit(LONG))
    return bound(_bytes_of(word), lambda b: F.aggregate(steps(b), begin(b), step, lambda e: F.slice(e, 2, F.size(e) - 2)))


def fold_long(c: Column, word: Column, size: int) -> Column:
    """Ids of one pre-token of any length, taken apart where no token spans."""
    none = F.array().cast("array<int>")
    taken = _bytes_of(word)

    def rank(a: Column, b: Column) -> Column:
        key = a.cast("long") * (size + 1) + b
        return F.coalesce(F.try_element_at(c["pairs"][_bucket(key)], key), F.lit(_NONE))

    def ranks(p: Column) -> Column:  # of all neighbours
        return F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: rank(x, p[i + 1]))

    def state(p: Column, r: Column) -> Column:
        return F.struct(p.alias("p"), r.alias("r"))

    def one(s: Column, low: Column) -> Column:
        """s with the first pair of rank low merged; two ranks are new."""

        def at(k: Column) -> Column:  # place of the left one of the pair, from 1
            p, r = s["p"], s["r"]
            left = F.when(k > 1, F.array(rank(F.get(p, k - 2), low))).otherwise(none)
            right = F.when(k + 2 <= F.size(p), F.array(rank(low, F.get(p, k + 1)))).otherwise(none)
            return state(F.concat(F.slice(p, 1, k - 1), F.array(low), F.slice(p, k + 2, F.size(p))), F.concat(F.slice(r, 1, F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(r))))

        return F.transform(F.array(F.array_position(s["r"], low).cast("int")), at)[0]

    def every(s: Column, low: Column) -> Column:
        """s with the pairs of rank low merged as one by one from the left; of pairs that overlap, as in a run of one byte, every second one."""

        def spliced(sel: Column) -> Column:  # sel: places of the left ones, from 0
            begin = lambda j: F.when(j == 0, F.lit(1)).otherwise(F.get(sel, j - 1) + 3)
            end = lambda j: F.coalesce(F.get(sel, j), F.size(s["p"]))
            part = lambda j: F.concat(F.slice(s["p"], begin(j), end(j) - begin(j) + 1), F.when(j < F.size(sel), F.array(low)).otherwise(none))
            whole = F.flatten(F.transform(F.sequence(F.lit(0), F.size(sel)), part))
            return F.transform(F.array(whole), lambda p: state(p, ranks(p)))[0]

        def apart(at: Column) -> Column:
            first = F.filter(at, lambda i, k: (k == 0) | (F.get(at, k - 1) != i - 1))
            last = F.filter(at, lambda i, k: F.coalesce(F.get(at, k + 1) != i + 1, F.lit(True)))
            return F.transform(F.array(F.flatten(F.zip_with(first, last, lambda a, b: F.sequence(a, b, F.lit(2))))), in_order)[0]

        def in_order(sel: Column) -> Column:
            """Merges up to the first after which a neighbour ranks lower than low, so that it must come before the rest."""
            before = lambda i, k: F.when((k > 0) & (F.get(sel, k - 1) == i - 2), low).otherwise(F.get(s["p"], i - 1))
            lower = lambda i, k: F.least(rank(before(i, k), low), rank(low, F.get(s["p"], i + 2))) < low
            upto = lambda stop: F.transform(F.array(F.filter(sel, lambda i: F.coalesce(i <= F.get(stop, F.lit(0)), F.lit(True)))), spliced)[0]
            return F.transform(F.array(F.filter(sel, lower)), upto)[0]

        return F.transform(F.array(F.filter(F.sequence(F.lit(0), F.size(s["r"]) - 1), lambda i: s["r"][i] == low)), apart)[0]

    def step(s: Column, _: Column) -> Column:
        low = F.coalesce(F.array_min(s["r"]), F.lit(_NONE))
        merged = lambda low: F.when(low == _NONE, state(s["p"], none)).when(F.size(s["p"]) < LONG, one(s, low)).otherwise(every(s, low))
        return F.transform(F.array(low), merged)[0]

    def stretch(b: Column) -> Column:
        steps = F.when(F.size(b) > 1, F.sequence(F.lit(2), F.size(b))).otherwise(none)
        start = F.transform(F.array(F.transform(b, lambda x: c["bytes"][x])), lambda p: state(p, ranks(p)))[0]
        return F.aggregate(steps, start, step, lambda s: s["p"])

    def split(b: Column) -> Column:
        cuts = F.filter(F.when(F.size(b) > 1, F.sequence(F.lit(1), F.size(b) - 1)).otherwise(none), lambda i: ~c["beside"][b[i - 1] * 256 + b[i]])
        ends = F.concat(F.array(F.lit(0)), cuts, F.array(F.size(b)))
        parts = lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda j: F.slice(b, e[j] + 1, e[j + 1] - e[j]))
        return F.transform(F.array(ends), parts)[0]

    return F.transform(F.array(taken), lambda b: F.flatten(F.transform(split(b), stretch)))[0]


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern_for_java(pattern)), F.lit(0))


def _word_bucket(word: Column) -> Column:
    return _bucket(F.hash(word))


def common_words(docs: DataFrame, text: str, pattern: str, vocabulary: Vocabulary) -> dict[int, dict[str, list[int]]]:
    """The frequent words of a sample and their ids, by bucket."""
    spark = docs.sparkSession
    share = int(min(1.0, SAMPLE / max(1, docs.count())) * 1_000_000)
    drawn = docs.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < share).select(F.explode(words_of(F.col(text), pattern)).alias("w"))
    # counted first, then folded by a plan of its own, which holds the vocabulary and no shuffle
    words = written(drawn.groupBy("w").count().orderBy(F.desc("count"), "w").limit(WORDS).select("w").repartition(4 * spark.sparkContext.defaultParallelism))
    out: dict[int, dict] = {}
    with _unprinted(spark):
        for r in words.select("w", _word_bucket(F.col("w")).alias("b"), bound(vocabulary.fold, lambda c: fold(c, F.col("w"), vocabulary.size)).alias("ids")).collect():
            out.setdefault(r["b"], {})[r["w"]] = r["ids"]
    return out


def _word_maps(words: dict[int, dict[str, list[int]]], value: Callable[[list[int]], object], kind: str) -> Column:
    """A literal array of small maps from words to values of their ids, by bucket."""
    # by bucket, so that the driver never holds all values as Python objects
    parts = (json.dumps({w: value(ids) for w, ids in words.pop(b, {}).items()}, ensure_ascii=False, separators=(",", ":")) for b in range(BUCKETS))
    return _literal(f"[{','.join(parts)}]", f"array<map<string,{kind}>>")


def encoded(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, Vocabulary]:
    """(ident, ids) for each row of docs, and the vocabulary.

    ids are those of the tiktoken library for the same ranks and pattern, each match of the pattern encoded by itself
    and no special tokens. A null or empty text has no ids. Other columns are not read; rows that repeat repeat; an
    empty table gives an empty one. Letters and numbers are those of the JVM's Unicode version.
    """
    vocabulary = Vocabulary(read_ranks(ranks_path))
    known = _word_maps(common_words(docs, text, pattern, vocabulary), list, "array<int>")
    both = F.struct(vocabulary.fold.alias("fold"), known.alias("words"))
    ids = lambda c, w: F.coalesce(F.try_element_at(c["words"][_word_bucket(w)], w), fold(c["fold"], w, vocabulary.size))
    words = words_of(F.col(text), pattern)
    return docs.select(F.col(ident), bound(both, lambda c: F.flatten(F.transform(words, lambda w: ids(c, w)))).alias("ids")), vocabulary


def id_bytes(ids: Column, vocabulary: Vocabulary) -> Column:
    """ids as little-endian unsigned 32-bit integers."""
    return bound(vocabulary.numbers, lambda n: F.encode(F.array_join(F.transform(ids, lambda i: n[i]), ""), "ISO-8859-1"))


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that ids stand for: their binary pieces, concatenated."""
    return bound(vocabulary.pieces, lambda n: F.encode(F.array_join(F.transform(ids, lambda i: n[i]), ""), "ISO-8859-1"))


def digests(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: ident, n_tokens, ids_sha256, decoded_sha256; see encoded().

    Each word gives the bytes of its ids and the pieces that these stand for, which are joined by text; for frequent words both stand in the literal.
    The rows are written once, so that no later plan holds the literals.
    """
    vocabulary = Vocabulary(read_ranks(ranks_path))
    size, marks = vocabulary.size, vocabulary.marks
    value = lambda ids: {"n": "".join(marks[i][0] for i in ids), "p": "".join(marks[i][1] for i in ids)}
    known = _word_maps(common_words(docs, text, pattern, vocabulary), value, "struct<n:string,p:string>")
    constants = F.struct(vocabulary.fold.alias("fold"), vocabulary.both.alias("both"), known.alias("words"))
    joined = lambda a: F.struct(F.array_join(a["n"], "").alias("n"), F.array_join(a["p"], "").alias("p"))

    def folded(c: Column, w: Column) -> Column:
        short = lambda: F.transform(fold_short(c["fold"], w, size), lambda x: c["both"][x.bitwiseAND(_MASK).cast("int")])
        long = F.transform(fold_long(c["fold"], w, size), lambda i: c["both"][i])
        return bound(long if size >= _MASK else F.when(F.octet_length(w) < LONG, short()).otherwise(long), joined)

    of = lambda c, w: F.coalesce(F.try_element_at(c["words"][_word_bucket(w)], w), folded(c, w))
    rows = docs.select(F.col(ident), bound(constants, lambda c: bound(F.transform(words_of(F.col(text), pattern), lambda w: of(c, w)), joined)).alias("_of"))
    out = rows.select(
        ident,
        (F.length("_of.n") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.encode("_of.n", "ISO-8859-1"), 256).alias("ids_sha256"),
        F.sha2(F.encode("_of.p", "ISO-8859-1"), 256).alias("decoded_sha256"),
    )
    with _unprinted(docs.sparkSession):
        return written(out)
