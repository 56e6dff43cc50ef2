"""Token counts of whole texts, equal to the tokenizers library's, by a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those that come out as one token are the
proven whole tokens. A pre-token among them counts one without merging; only the rest are merged, each distinct one
once per task while it is remembered.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import ready, release, slices

#: How the byte-level pre-tokenizer splits text. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a task remembers.
REMEMBERED = 600_000

#: The same split for texts of common characters only, in which Python's classes are those of the pattern.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
#: Matches a character that is not common: beyond ASCII, Latin and Cyrillic letters and general punctuation.
UNCOMMON = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏЀ-џ‐-‧‰-⁞]").search
_FULL = regex.compile(PATTERN).findall


def load(path: str):
    """The library's tokenizer, on one thread: tasks run side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(text: str) -> list[str] | None:
    """The pattern's matches in text; None if it holds a character whose class is unsure."""
    if not UNCOMMON(text):
        return _FAST(text)
    return None if unsure().search(text) else _FULL(text)


@lru_cache(maxsize=1)
def unsure():
    """Matches characters whose class libraries of different Unicode versions may see differently; texts with one are left whole to the library."""
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(every)
    is_letter, is_number = set(regex.findall(r"\p{L}", text)), set(regex.findall(r"\p{N}", text))
    odd = []
    for c in every:
        kind = unicodedata.category(c)
        if kind == "Cn" or (kind[0] == "L") != (c in is_letter) or (kind[0] == "N") != (c in is_number):
            if odd and ord(c) == odd[-1][1] + 1:
                odd[-1][1] += 1
            else:
                odd.append([ord(c), ord(c)])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in odd) + "]")


def one_piece():
    """A pre-tokenizer that spells bytes as letters and splits nothing."""
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=False)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Ids by bytes if merges rank as their ids do, so that a library of ranks gives the same ids; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back, vocab = byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(m)] for m in pairs]
    single = [p for p in vocab if len(p) == 1]
    if made != sorted(made) or len(set(made)) + len(single) != len(vocab) or not all(c in back for p in vocab for c in p):
        return None
    return {bytes(back[c] for c in p): i for p, i in vocab.items()}


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that the library encodes, alone, as one token: the proof behind the shortcut."""
    tok, back = load(path), byte_letters()
    specials = {t.content for t in tok.get_added_tokens_decoder().values()}
    texts = []
    for piece in tok.get_vocab():
        if piece not in specials and all(c in back for c in piece):
            try:
                texts.append(bytes(back[c] for c in piece).decode())
            except UnicodeDecodeError:
                pass
    return [t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1]


class TokenCounter:
    """Counts tokens of texts; made once per task."""

    def __init__(self, path: str, whole: tuple[str, ...]):
        self.tok, self.plain = load(path), load(path)
        self.plain.pre_tokenizer = one_piece()
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def learn(self, words: list[str]) -> None:
        """Merge the pre-tokens that are not known."""
        if len(self.known) > len(self.whole) + REMEMBERED:
            self.known = dict(self.whole)
        new = list({w for w in words if w not in self.known})
        self.known.update(zip(new, map(len, self.plain.encode_batch_fast(new, add_special_tokens=False))))

    def count(self, text: str) -> int:
        """Tokens of a text without special strings."""
        words = pre_tokens(text)
        if words is None:
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            return sum(map(self.known.__getitem__, words))

    def __call__(self, texts: list[str | None]) -> list[int]:
        out = []
        for text in texts:
            text = text or ""
            if self.special is not None and (hits := self.special.findall(text)):
                out.append(len(hits) + sum(map(self.count, self.special.split(text))))
            else:
                out.append(self.count(text))
        return out


@lru_cache(maxsize=1)
def counter(path: str, whole: tuple[str, ...]) -> TokenCounter:
    """The counter of a worker; tasks forget their pre-tokens at the end."""
    return TokenCounter(path, whole)


def counted(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: ident, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a byte-level BPE file of the tokenizers library, readable on every machine. Null and empty texts have no bytes and no
    tokens. Special strings inside a text count as their one token, as the library does by default; none are added,
    nothing is cut. Other columns are not read; an empty table gives an empty one; rows that repeat repeat.
    """
    ready(docs.sparkSession)
    proven = docs.sparkSession.sparkContext.broadcast(tuple(whole_tokens(path)))  # bounded by the vocabulary
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_t"))

    def count(batches):
        count_all = counter(path, proven.value)
        for whole in batches:
            for batch in slices(whole):
                n = count_all(batch.column("_t").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[ident, "n_bytes", "n_tokens", "over_limit"])
        count_all.known = dict(count_all.whole)
        release()

    return rows.mapInArrow(count, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
