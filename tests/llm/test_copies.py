"""Exact copies, near copies of texts and of vectors, components: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gable.llm.common import shingle_sets
from gable.llm.components import connected_components
from gable.llm.embedding_dedup import near_vectors
from gable.llm.exact_dedup import exact_groups, without_copies
from gable.llm.ngram_join import near_copies, one_of_each, pruning_table


def union(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, 2001), (2000, 2001)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union({x for p in links for x in p}, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in touched}


@pytest.mark.parametrize("links", [[(1, 3), (2, 3)], [(9, 4), (9, 5), (9, 6), (20, 11), (20, 12), (31, 30)]])
def test_components_of_stars_around_the_largest(spark, links):
    got = sorted((r.id, r.component) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == sorted(union({x for p in links for x in p}, links).items())


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (5, "a b "), (6, "x" * 100_000), (7, "x" * 100_000), (8, "ü"), (9, "ü")]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact(spark, keep):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, k string, n long")
    got = {r.doc_id: r for r in exact_groups(docs, keep=keep).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        same = [j for j, u in ROWS if (u or "") == (t or "")]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == ((max if keep == "max" else min)(same), len(same), r.keep_id == i)
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    left = without_copies(docs, keep=keep)
    assert left.columns == docs.columns and left.count() == 6


def test_exact_with_colliding_hashes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs, hasher=lambda t: F.length(t).cast("string").cast("binary")).collect()}
    want = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs).collect()}
    assert got == want


ODD_IDS = [(None, "a a"), (None, "b b"), (None, "b b"), (7, "c c"), (7, "d d"), (None, "d d"), (8, "e"), (8, "e"), (None, None)]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_with_null_and_repeated_ids(spark, keep):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ODD_IDS)], "doc_id long, text string, k int")
    left = without_copies(docs, keep=keep)
    assert left.dtypes == docs.dtypes
    assert {(r.doc_id, r.text, r.k) for r in left.collect()} == {(None, "a a", 0), (None, "b b", 1), (7, "c c", 3), (7, "d d", 4), (8, "e", 6), (None, None, 8)} and left.count() == 6
    got = exact_groups(docs, keep=keep, hasher=lambda t: F.length(t).cast("string").cast("binary")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_groups(docs, keep=keep).collect())
    assert sum(r.kept for r in got) == 8


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, "x"), (2, "a b", 1, 2, 3, "y"), (3, "c", 0, 0, 0, None)], "doc_id long, text string, _stay int, _row int, _least int, kept string")
    for stage, kept in ((without_copies, {2, 3}), (one_of_each, {1, 3})):
        left = stage(docs)
        assert left.dtypes == docs.dtypes and {r.doc_id for r in left.collect()} == kept and stage(docs.limit(0)).count() == 0


def test_near_with_ids_of_strings(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_copies(docs).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_exact_of_nothing(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def vectors(n=300, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, 16))
    out = []
    for i in range(n):
        v = base[rng.integers(40)] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.3, 0.6])
        out.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])]))
    return out


def test_vectors(spark):
    rows = vectors() + [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [float("nan")] * 16), (904, [float("inf")] * 16), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e300] * 16), (909, [1e-300] * 16)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), miss=1e-9).collect()}
    ok = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ok = {i: v / np.sqrt(v @ v) for i, v in ok.items()}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    comp = union([i for i, _ in rows], links)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), comp[i], comp[i] == i), i


def test_vectors_in_small_blocks(spark, monkeypatch):
    import gable.llm.embedding_dedup as m

    monkeypatch.setattr(m, "BLOCK", 5)
    test_vectors(spark)


def near_texts():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(500)]
    out = []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 12, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.3 else " ".join(w))
    base = [rng.choice(vocab) for _ in range(120)]
    for i in range(60):  # a group of near copies
        w = list(base)
        w[i] = "new%d" % i
        out.append(" ".join(w))
    return [(i * 3 + 1, t) for i, t in enumerate(out)] + [(9001, None), (9002, ""), (9003, "  \n"), (9004, "one"), (9005, "One"), (9006, "y " * 50_000), (9007, "y " * 50_000)]


def jaccard_links(rows, t=0.8):
    sets = dict(zip([i for i, _ in rows], [set(s.tolist()) for s in shingle_sets([x for _, x in rows])]))
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9]


def test_shingles_are_those_of_words():
    a, b, c, d = shingle_sets(["a b c d e f", "x a b c d e", "a  B\nc d e f ", "a b"])
    assert len(a) == 2 and len(np.intersect1d(a, b)) == 1 and (a == c).all() and len(d) == 1
    assert len(shingle_sets([None, ""])[0]) == 0


def test_near(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, size int, keys string")
    links = jaccard_links(rows)
    comp = union([i for i, _ in rows], links)
    got = {r.doc_id: r for r in near_copies(docs).collect()}
    assert len(got) == len(rows) and len(links) > 500
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in links), comp[i], comp[i] == i), i
    left = one_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in comp if comp[i] == i}


def test_near_in_small_blocks(spark, monkeypatch):
    import gable.llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 4000)
    test_near(spark)


def test_near_with_null_and_repeated_ids(spark):
    base = ["w%d" % i for i in range(100)]
    near = lambda k, s="": " ".join("new" + s if i == k else w + s for i, w in enumerate(base))
    rows = [(None, near(0)), (5, near(9)), (5, near(99)), (5, near(9, "x")), (None, near(9, "x")), (None, near(0, "y")), (None, near(99, "y")), (None, near(1, "z")), (6, "one"), (6, "two"), (None, None), (8, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    left = one_of_each(docs)
    assert left.dtypes == docs.dtypes
    kept = [r.k for r in left.collect()]
    assert len(kept) == len(set(kept)) == 8 and {3, 7, 8, 9, 10, 11} <= set(kept)
    assert len({1, 2} & set(kept)) == 1 and len({5, 6} & set(kept)) == 1
    got = near_copies(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_links) for r in got) == sorted([("None", "5", 2), ("5", "5", 2), ("5", "5", 2), ("5", "5", 1), ("None", "5", 1), ("None", "None", 1), ("None", "None", 1), ("None", "None", 0), ("6", "6", 0), ("6", "6", 0), ("None", "None", 0), ("8", "8", 0)])


def test_near_of_nothing(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    least = pruning_table(0.8)
    assert list(least) == sorted(least) and 0 < least[0] < 16 * 0.8 and least[-1] < 128 * 0.8
