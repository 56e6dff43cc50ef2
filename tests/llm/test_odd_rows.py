"""Rows that tell apart by themselves (embeddings, stages), ranks of threads in chains and circles, and repeats of 18 to 50 words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gable.llm.components import connected_components
from gable.llm.embedding_dedup import near_vectors
from gable.llm.exact_dedup import without_copies
from gable.llm.ngram_join import one_of_each
from gable.llm.paragraph_dedup import repeated_passages
from gable.llm.quotation import levels, thread_ranks


def brute_vectors(rows, at=0.9):
    """(id, links, component, kept) of each row, by all pairs of rows."""
    x = [np.array(v, float) for _, v in rows]
    x = [v / np.linalg.norm(v) for v in x]
    near = [[j for j in range(len(x)) if j != i and x[i] @ x[j] >= at] for i in range(len(x))]
    out = []
    for i in range(len(x)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        k = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), k, rows[i][0] == k))
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vectors_with_null_repeated_and_text_ids(spark, kind):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 24))
    rows = [(i % 9 if i % 4 else None, (base[i % 12] + rng.normal(size=24) * rng.choice([0, 0.05, 0.3])).tolist()) for i in range(90)]
    rows += [(3, base[0].tolist()), (3, base[5].tolist()), (3, base[5].tolist()), (None, (-base[7]).tolist()), (77, (-base[8]).tolist())]
    if kind == "string":
        rows = [(i if i is None else f"v{i}", v) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>").repartition(4)
    order = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    assert sorted(map(tuple, near_vectors(df, miss=1e-9).collect()), key=order) == sorted(brute_vectors(rows), key=order)


@pytest.mark.parametrize("links", [50_000, 3])
def test_ranks_of_chains_and_circles(spark, links):
    chain = [(i, i + 1) for i in range(1, 30 if links == 3 else 400)]
    circle = [(1001, 1002), (1002, 1003), (1003, 1001), (1004, 1001), (1004, 1005)]
    tree = [(2001, 2002), (2001, 2003), (2003, 2002), (2004, 2001), (2005, 2002)]
    across = spark.createDataFrame(chain + circle + tree, "a long, b long")
    got = dict(thread_ranks(across, connected_components(across), links).collect())
    n = len(chain)
    assert got == {i: n + 1 - i for i, _ in chain} | {1001: 0, 1002: 0, 1003: 0, 1004: 0} | {2001: 2, 2003: 1, 2004: 3, 2005: 1}
    assert thread_ranks(across.limit(0), connected_components(across.limit(0)), links).count() == 0 and levels([1], [2]) == {1: 1}


def test_stages_take_columns_without_an_order(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, {"b": 2}), (1, text, {"a": 1}), (2, text, {"a": 1}), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, facts map<string,int>")
    assert [(r["doc_id"], r["facts"]) for r in without_copies(df).orderBy("doc_id").collect()] == [(None, None), (2, {"a": 1})]
    assert [(r["doc_id"], r["facts"]) for r in one_of_each(df).orderBy("doc_id").collect()] == [(None, None), (1, {"a": 1})]


def test_repeats_of_eighteen_to_fifty_words(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "bdfglmnprst"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    docs, planted = [], {}
    for k in range(60):
        n = 18 + k * 32 // 59
        p = some(n)
        q = list(p)
        if k % 2 and n >= 40:
            q[n // 2] = "edited"
        docs += [(2 * k, " ".join([*some(120), *p, *some(120)])), (2 * k + 1, " ".join([*some(90), *q, *some(150)]))]
        planted[2 * k + 1] = set(q)
    got = {}
    for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).where("removed").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) <= set(planted) and len(got) >= 0.95 * len(planted)
