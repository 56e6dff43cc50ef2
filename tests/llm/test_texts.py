"""Token counts, language, packing and repeated passages: against the libraries, held-out labels and brute force."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gable.llm.language_id import identified, in_known_language
from gable.llm.packing import ShardIndex, fill, packed, powers
from gable.llm.packing import best_unused as m_best
from gable.llm.paragraph_dedup import SHINGLE, Paragraphs, _alike, _numbered, _runs, aligned, repeated_passages, without_repeats
from gable.llm.token_counts import PATTERN, counted, unsure, whole_tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n  a", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "don't I'LL 've", "ünïcødé 漢字 😀👍🏽", "12 345,6 x²", "\x1c\x85\xa0  a​", "x" * 30_000, "a b " * 20_000, "tab\tend  \r\n ", "é", "�\x00", "\uab6c a\uab6cb \U00012550"]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(ODD + ["a b ", ""])], "doc_id long, text string, lang string, source string, n_chars int")
    return real.unionByName(odd.select(*[F.col(c).cast(real.schema[c].dataType) for c in real.columns])).withColumn("tail", F.lit("clash")).cache()


def test_pattern_is_the_published_one():
    assert PATTERN == public_tokenizers.PATTERN


def test_pre_tokens_agree_with_the_library(tok):
    import regex

    find = regex.compile(PATTERN).findall
    for c in [*range(1, 0xD800, 3), *range(0x1C, 0x100), *range(0x2000, 0x2070), 0x3000, 0xFEFF, *range(0x1F600, 0x1F610)]:
        text = f"a{chr(c)} {chr(c)}b1"
        if unsure().search(text):
            continue
        assert len(find(text)) == len(tok.pre_tokenizer.pre_tokenize_str(text)), hex(c)


def test_whole_tokens_are_proven(tok):
    whole = whole_tokens(JSON)
    assert len(whole) > 45_000 and " the" in whole
    for w in random.Random(1).sample(whole, 300):
        assert len(tok.encode(w, add_special_tokens=False).ids) == 1


def test_counts(spark, docs, tok):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = counted(docs, JSON).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512), texts[r.doc_id]
    assert counted(docs.limit(0), JSON).count() == 0


def test_language(spark, docs):
    got = {r.doc_id: r for r in identified(docs).collect()}
    want = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert set(got) == set(want)
    right = [got[i].lang_pred == l for i, (l, _) in want.items() if l and got[i].held_out]
    assert len(right) > 20 and np.mean(right) > 0.9
    for i, (_, t) in want.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert (got[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= got[i].score <= 1
    kept = in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got.values())


def test_language_by_hand(spark, docs):
    """Family and pair votes of each text, one by one."""
    import gable.llm.language_id as m

    model = m.fit(docs)
    def winner(kind, x, names):
        votes, margins = [0] * len(names), [0.0] * len(names)
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                w = model.weights[kind, names[a], names[b]]
                s = float(x @ w[:-1] + w[-1])
                votes[a if s >= 0 else b] += 1
                margins[a] += np.tanh(s)
                margins[b] -= np.tanh(s)
        return max(range(len(names)), key=lambda k: (votes[k], margins[k]))

    got = {r.doc_id: r.lang_pred for r in identified(docs, model=model).collect()}
    for r in docs.collect():
        x = m.features(r.text)
        if x is None:
            assert got[r.doc_id] == "und"
            continue
        groups = sorted(model.families)
        inner = model.families[groups[winner("family", x, groups)]]
        assert got[r.doc_id] == inner[winner("lang", x, inner)]


def test_language_of_odd_tables(spark):
    """Languages without letters, many languages, repeated and null ids."""
    rows = [(i, "1 2 %d" % i, "xx" if i % 2 else "yy") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identified(df).collect()} == {"und"} and in_known_language(df).count() == 0
    words = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=9)) for k in range(70)]
    many = [(i, " ".join([words[i % 70]] * 5), "l%d" % (i % 70)) for i in range(700)]
    same = [(5, "same words here", "l0")] * 500 + [(None, "no id", "l1"), (None, None, None), (8, "free text", None)]
    df = spark.createDataFrame(many + same, "doc_id long, text string, lang string")
    got = identified(df).collect()
    assert len(got) == 1203 and len({r.lang_pred for r in got}) > 60
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    unknown = spark.createDataFrame([(1, "words", None), (2, "1 2", None), (None, "more", None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in in_known_language(unknown).collect()) == ["more", "words"]


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identified(none).collect()] == ["und"]
    one = spark.createDataFrame([(i, "some text %d" % i, "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identified(one).collect()} == {"en"}
    assert identified(none.limit(0)).count() == 0


def test_fill_covers_everything():
    rng = np.random.default_rng(2)
    for n in (1, 2, 40):
        lengths = rng.integers(0, 1024, n).tolist()
        terms = [np.unique(rng.integers(0, 50, 12)).astype("<u2") for _ in range(n)]
        index = ShardIndex(terms, [np.ones(len(t)) for t in terms], np.full(n, 12.0), np.ones(50), 12.0)
        seqs = fill(lengths, index)
        at = defaultdict(list)
        for s in seqs:
            size = sum(x[2] for x in s)
            assert size == 1024 or size & (size - 1) == 0
            for d, b, k in s:
                at[d].append((b, k))
        for d, l in enumerate(lengths):
            end = 0
            for b, k in sorted(at[d]):
                assert b == end and k > 0
                end = b + k
            assert end == l
    assert powers(1023) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1] and powers(0) == []


def test_scores_are_bm25():
    terms = [np.array([1, 2], "<u2"), np.array([2, 3], "<u2"), np.array([4], "<u2")]
    index = ShardIndex(terms, [np.array([1, 2]), np.array([3, 1]), np.array([1])], np.array([3.0, 4.0, 1.0]), np.array([0, 1, 2, 3, 4.0]), 3.0)
    s = index.scores(0)
    assert s[2] == 0 and s[1] == pytest.approx(2 * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / 3)))


def check_packing(pieces, ids):
    of, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        of[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(of) == set(ids)
    for i, rs in of.items():
        end = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == end and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][end : end + r.length], "<u4").tobytes())
            end += r.length
        assert end == len(ids[i])
    padding = 0
    for rs in seqs.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    return padding


def test_shards_hold_the_neighbours(spark):
    """The best neighbours in a document's own shard are as good, nearly, as those of the whole corpus."""
    import gable.llm.packing as m

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect()]
    encode, vocab, dtype = m.encoder(JSON), m.load(JSON).get_vocab_size(), np.dtype("<u2")
    sketch = m.sketch_of(spark.createDataFrame([(t,) for t in texts], "_t string"), JSON, vocab, dtype)
    ids = [encode(t) for t in texts]
    terms, counts = zip(*(np.unique(x, return_counts=True) for x in ids))
    df = np.bincount(np.concatenate(terms), minlength=vocab)
    index = ShardIndex(list(terms), list(counts), np.array([len(x) for x in ids], float), m.idf_of(df, len(ids)), np.mean([len(x) for x in ids]))
    order = np.lexsort(sketch(list(terms))[::-1])
    shard = np.empty(len(ids), int)
    shard[order] = np.cumsum([len(terms[d]) for d in order]) // 25_000
    assert shard.max() >= 6
    ours = best = 0.0
    for d in range(0, len(ids), 7):
        s = index.scores(d)
        s[d] = 0
        best += np.sort(s)[-4:].sum()
        ours += np.sort(s[shard == shard[d]])[-4:].sum()
    assert ours >= 0.9 * best


def test_best_unused_is_the_order_of_scores():
    rng = np.random.default_rng(1)
    s, used = rng.integers(0, 40, 500).astype(float), rng.random(500) < 0.3
    got = list(m_best(s, used))
    assert sorted(got) == np.flatnonzero(~used).tolist() and (np.diff(s[got]) <= 0).all()


def test_fill_reads_no_postings_of_used_documents():
    """The same sequences as with the whole index throughout, from a good deal fewer postings."""

    class Whole(ShardIndex):
        read = 0

        def only(self, wanted):
            return self

        def scores(self, doc):
            type(self).read += int(self.size[np.searchsorted(self.vocab, self.terms[doc])].sum())
            return super().scores(doc)

    class Narrowed(Whole):
        read, only = 0, ShardIndex.only

    rng = np.random.default_rng(3)
    terms = [np.unique(rng.zipf(1.3, 60) % 900).astype("<u2") for _ in range(300)]
    lengths = rng.integers(0, 1024, 300).tolist()
    whole, narrowed = (kind(terms, [np.ones(len(t)) for t in terms], np.full(300, 60.0), np.arange(900) % 7 + 1.0, 60.0) for kind in (Whole, Narrowed))
    assert fill(lengths, narrowed) == fill(lengths, whole)
    assert 0 < Narrowed.read < 0.75 * Whole.read
    wanted = rng.random(300) < 0.4
    assert (narrowed.only(wanted).scores(5)[wanted] == narrowed.scores(5)[wanted]).all() and not narrowed.only(wanted).scores(5)[~wanted].any()


def test_ids_of_whole_texts_are_the_librarys(tok):
    from gable.llm.packing import encoder

    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "th", "don't", "'LL", "'ll", " ", " ", "  ", "\n", "\r\n", "\t", "_", "12", "é", "ñ", "Й", "½", "«", "—", "…", "!?", "ß"], k=40)) for _ in range(400)]
    for t in [*texts, "x" * 3000, "a" * 700 + "  " + "b1" * 400, "a  ", "  ", "\u0300a \x85 b"]:
        assert encoder(JSON)(t).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t


def test_packing(spark, docs, tok, monkeypatch):
    import gable.llm.packing as m

    monkeypatch.setattr(m, "SHARD", 4000)
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.select("doc_id", "text").collect()}
    assert check_packing(packed(docs, JSON).collect(), ids) == 0
    assert packed(docs.limit(0), JSON).count() == 0


def passages_by_hand(rows, least=50):
    """Ids of documents that share `least` words in a row."""
    at = defaultdict(set)
    for i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - least + 1):
            at[" ".join(w[k : k + least])].add(i)
    return {i for v in at.values() if len(v) > 1 for i in v}


def planted():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(3000)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [some(rng.randrange(51, 90)) for _ in range(12)]
    rows = []
    for i in range(240):
        parts = [some(rng.randrange(5, 150))]
        if i % 3 == 0:
            parts += [shared[rng.randrange(12)], some(rng.randrange(5, 100))]
        rows.append((i, (" " if i % 2 else "\n").join(parts)))
    return rows + [(900, None), (901, ""), (902, "a b c"), (903, "again " * 400), (904, "again " * 400), (905, some(9) + " short line of license words only " + some(9)), (906, some(9) + " short line of license words only " + some(9))]


def test_paragraph_cuts_do_not_depend_on_the_batch():
    texts = [t for _, t in planted()[:40]] + [None, "", "a b c d", "a b c d e"]
    all_at_once, (key, doc, place) = Paragraphs(texts), Paragraphs(texts).bands()
    for d, t in enumerate(texts):
        alone, of = Paragraphs([t]), all_at_once.doc == d
        assert (all_at_once.start[of] == alone.start).all() and (all_at_once.count[of] == alone.count).all()
        k, _, p = alone.bands()
        assert (key[doc == d] == k).all() and (place[doc == d] == p).all()
        if t and len(t.split()) >= 5:
            assert alone.start[0] == 0 and (alone.start[1:] == alone.start[:-1] + alone.count[:-1]).all() and alone.start[-1] + alone.count[-1] + 4 == len(t.split())


def shingles(words):
    return set(zip(*(words[k:] for k in range(5))))


def test_repeats(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "x", 7, 1, "c") for i, t in rows], "doc_id long, text string, units string, n_chars int, _cut int, _spans string")
    got = repeated_passages(docs).collect()
    want = passages_by_hand(rows)
    assert {r.doc_id for r in got} == want
    text = {i: (t or "").lower().split() for i, t in rows}
    for r in got:
        said = text[r.doc_id][r.start_word : r.start_word + r.n_words]
        assert len(said) == r.n_words >= 40 and r.removed == ((r.doc_id, r.start_word) != (r.class_doc_id, r.class_start))
        assert r.doc_id == 904 or not r.removed or " ".join(said) in " ".join(text[r.class_doc_id])
    left = without_repeats(docs, length="n_chars")
    assert left.columns == docs.columns
    after = {r.doc_id: r for r in left.collect()}
    assert len(after) == len(rows) and passages_by_hand([(i, r.text) for i, r in after.items()], 30) == set()
    removed = {r.doc_id for r in got if r.removed}
    for i, t in rows:
        assert (after[i].text == t) == (i not in removed)
        assert after[i].n_chars == (len(after[i].text) if i in removed else 7)


def test_edited_passages_are_found_whole(spark):
    """One word changed, put in or left out of passages of 50 to 100 words: nearly all found, to their edges."""
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(3000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, want = [], {}
    for k in range(0, 400, 2):
        p = some(rng.randrange(50, 101))
        q, x = list(p), rng.randrange(6, len(p) - 6)
        q[x : x + rng.randrange(2)] = ["edit%d" % k] * rng.randrange(2)
        before = some(rng.randrange(20, 150))
        rows += [(k, " ".join(some(40) + p + some(60))), (k + 1, " ".join(before + q + some(50)))]
        if len(shingles(p) & shingles(q)) >= 0.8 * len(shingles(p) | shingles(q)):
            want[k + 1] = (len(before), len(q))
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.removed}
    assert set(got) <= set(range(1, 400, 2)) and all(r.class_doc_id == i - 1 for i, r in got.items())
    found = [i for i, (s, n) in want.items() if i in got and abs(got[i].start_word - s) <= 2 and abs(got[i].n_words - n) <= 4]
    assert len(want) > 180 and len(found) >= 0.95 * len(want)


def test_texts_that_share_a_phrase_keep_it(spark):
    """Thousands of texts with the same words around one key are no repetitions."""
    rng = random.Random(2)
    phrase = "the same five words here"
    rows = [(i, " ".join(["w%d" % rng.randrange(5000) for _ in range(30)] + [phrase] + ["w%d" % rng.randrange(5000) for _ in range(30)])) for i in range(3000)]
    assert repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_aligned():
    rng = random.Random(1)
    w = ["a%d" % rng.randrange(500) for _ in range(300)]
    assert aligned(w, w, 0) == [(0, 300, 0, 300)]
    other = ["b%d" % i for i in range(100)]
    assert aligned(other + w[:60] + other, w[:60], -100) == [(100, 160, 0, 60)]
    apart = w[:60] + other + w[60:120]
    assert sorted(aligned(apart, w[:120], 0)) == [(0, 60, 0, 60)]
    assert aligned(["y"] * 50_000, ["y"] * 60, 0)[0][2:] == (0, 60)
    assert aligned([], [], 0) == [] == aligned(["x"] * 17, ["x"] * 17, 0)


def longest_by_hand(block, a, b, threshold, least):
    """The longest window of runs that reaches the threshold by whole sets, then the longest of those that don't meet it."""
    left, found = [], []
    for x in range(len(block)):
        for y in range(x, len(block)):
            s, e, ls, le = block[x][0], block[y][1], block[x][2], block[y][3]
            p, q = ({tuple(t[k : k + SHINGLE]) for k in range(i, j + 1)} for t, i, j in ((a, s, e), (b, ls, le)))
            if min(e - s, le - ls) + SHINGLE >= least and len(p & q) >= threshold * len(p | q) - 1e-9:
                left.append((x, y, (s, e + SHINGLE, ls, le + SHINGLE)))
    for x, y, passage in sorted(left, key=lambda w: w[2][0] - w[2][1]):
        if all(y < v or w < x for v, w, _ in found):
            found.append((x, y, passage))
    return sorted(f[2] for f in found)


def test_longest_windows_of_runs():
    """One pass a first run gives what whole sets give for every window, with words that repeat, too."""
    some = 0
    for seed in range(60):
        rng = random.Random(seed)
        a = ["w%d" % rng.randrange(rng.choice([6, 3000])) for _ in range(300)]
        b = [w if rng.random() > rng.choice([0.02, 0.06]) else "x%d" % rng.randrange(9) for w in a]
        (wa, wb), (ga, gb) = _numbered(pa.array([" ".join(a), " ".join(b)]))
        runs = _runs(wa, wb, ga, gb, 0)
        if len(runs) > 1:
            got = sorted(_alike(runs, ga, gb, 0.8, 18))
            assert got == longest_by_hand(runs, a, b, 0.8, 18)
            some += len(got)
    assert some > 60


def test_long_edited_texts_align_soon():
    """Thousands of words with hundreds of edits that keep the whole below the threshold: seconds, not minutes."""
    rng = random.Random(5)
    a = ["w%d" % rng.randrange(4000) for _ in range(9000)]
    b = [w if rng.random() > 0.05 else "x" for w in a]
    began = time.monotonic()
    got = aligned(a, b, 0)
    assert time.monotonic() - began < 20 and got
    for s, e, ls, le in got:
        p, q = ({tuple(t[k : k + SHINGLE]) for k in range(i, j - SHINGLE + 1)} for t, i, j in ((a, s, e), (b, ls, le)))
        assert len(p & q) >= 0.8 * len(p | q) - 1e-9


def test_repeats_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    some = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    p, q = some(60), some(60)
    twice = some(10) + " " + q
    rows = [(None, some(20) + " " + p), (5, p + " " + some(30)), (5, twice), (5, twice), (None, q), (None, None), (7, some(80)), (7, some(80)), (8, "y " * 5000), (9, "y " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.removed, r.class_doc_id) for r in repeated_passages(docs).collect())
    assert got == sorted([("None", 60, True, 5), ("5", 60, False, 5), ("5", 60, False, 5), ("None", 60, True, 5), ("8", 85, False, 8), ("8", 4888, True, 8), ("9", 400, True, 8)])
    left = without_repeats(docs).collect()
    assert len(left) == len(rows) and sorted((r.text or "").strip() == "" for r in left) == [False] * 7 + [True] * 3


def test_repeats_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_passages(none).count() == 0 and without_repeats(none).count() == 0
