"""Pseudo-random draws that any engine repeats: a hash of seed, id and round as a number in [0, 1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, ident: Column, *more: Column) -> Column:
    """The first 32 bits of md5(seed|id|...) over 2^32."""
    text = F.concat_ws("|", F.lit(str(seed)), ident.cast("string"), *[m.cast("string") for m in more])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_one(u: Column, most: int = 8) -> Column:
    """How often a row is drawn in a bootstrap of many rows: the Poisson(1) quantile of u."""
    total, term, out = 0.0, 0.36787944117144233, F.lit(most)
    steps = []
    for k in range(most):
        total += term
        term /= k + 1
        steps.append((k, total))
    for k, edge in reversed(steps):
        out = F.when(u < edge, k).otherwise(out)
    return out
