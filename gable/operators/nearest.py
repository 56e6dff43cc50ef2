"""Nearest places by a tree over places of a checked number, which tasks hold; more places are taken in shares, one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that a task holds at a time, at most about, and places of a leaf.
MOST, LEAF = 200_000, 24


class PlaceTree:
    """A k-d tree in the plane. Of equally near places the one with the smallest number wins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.xy = np.stack([x, y])
        self.nodes: list[tuple] = []
        if len(x):
            self._grow(np.arange(len(x)))

    def _grow(self, part: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(self.xy[:, part], axis=1)
        if len(part) <= LEAF or not spread.max():
            self.nodes[at] = (np.sort(part),)
            return at
        dim = int(spread.argmax())
        order = part[np.argsort(self.xy[dim, part], kind="stable")]
        half = len(order) // 2
        self.nodes[at] = (dim, float(self.xy[dim, order[half]]), self._grow(order[:half]), self._grow(order[half:]))
        return at

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest place of each point, -1 if there is none, and its squared distance."""
        points, best, found = np.stack([x, y]), np.full(len(x), np.inf), np.full(len(x), -1)
        if self.nodes:
            self._look(0, np.arange(len(x)), points, best, found)
        return found, best

    def _look(self, at: int, who: np.ndarray, points: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        if not len(who):
            return
        node = self.nodes[at]
        if len(node) == 1:
            for a in range(0, len(who), 4096):
                w = who[a : a + 4096]
                dx, dy = (points[i, w][:, None] - self.xy[i, node[0]] for i in (0, 1))
                d = dx * dx + dy * dy
                j = d.argmin(axis=1)
                d, city = d[np.arange(len(w)), j], node[0][j]
                new = (d < best[w]) | ((d == best[w]) & (city < found[w]))
                best[w[new]], found[w[new]] = d[new], city[new]
            return
        dim, value, low, high = node
        off = points[dim, who] - value
        left = off < 0
        self._look(low, who[left], points, best, found)
        self._look(high, who[~left], points, best, found)
        near = off * off <= best[who]  # the other side may hold as near a place
        self._look(high, who[left & near], points, best, found)
        self._look(low, who[~left & near], points, best, found)


def with_nearest(points: DataFrame, places: DataFrame, lat: str, lon: str, out: str, most: int = MOST) -> DataFrame:
    """points with the struct `out` (d2, name, latitude, longitude) of the place nearest in degrees; equals go by name, then coordinates.

    places: (name, latitude, longitude). Null where a coordinate is missing or no number, or there is no place. Rows are not
    shuffled. Places are counted first: up to `most` are one tree that all tasks hold; more are dealt to shares of about that
    size by a hash, and every row is held against one share after the other.
    """
    spark = points.sparkSession
    places = places.select("name", F.col("latitude").cast("double"), F.col("longitude").cast("double")).where("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)").distinct()
    shares = max(1, -(-places.count() // most))
    kind = "struct<d2:double,name:string,latitude:double,longitude:double>"
    df = points.withColumn(out, F.lit(None).cast(kind))
    for share in range(shares):
        own = places.where(F.pmod(F.xxhash64("name", "latitude", "longitude"), F.lit(shares)) == share)
        rows = sorted(((r[0] or "", r[1], r[2], r[0]) for r in own.collect()), key=lambda r: r[:3])
        a, b = (np.array([r[i] for r in rows], float) for i in (1, 2))
        held = spark.sparkContext.broadcast((PlaceTree(a, b), pa.array([r[3] for r in rows], pa.string()), a, b))
        schema = df.schema
        i, j, k = (schema.names.index(c) for c in (lat, lon, out))

        def run(batches: Iterator[pa.RecordBatch], held=held, i=i, j=j, k=k) -> Iterator[pa.RecordBatch]:
            tree, names, a, b = held.value
            for batch in batches:
                x, y = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (i, j))
                ok = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
                found = np.full(batch.num_rows, -1)
                d2 = np.full(batch.num_rows, np.nan)
                found[ok], d2[ok] = tree.nearest(x[ok], y[ok])
                place = pa.array(found, pa.int64(), mask=found < 0)
                new = pa.StructArray.from_arrays([pa.array(d2), names.take(place), pa.array(a).take(place), pa.array(b).take(place)], ["d2", "name", "latitude", "longitude"], mask=pa.array(found < 0))
                if share:
                    old = batch.column(k).to_pylist()
                    key = lambda s: (s["d2"], s["name"] or "", s["latitude"], s["longitude"])
                    new = pa.array([p if q is None or (p is not None and key(p) <= key(q)) else q for p, q in zip(old, new.to_pylist())], new.type)
                yield pa.RecordBatch.from_arrays([new if c == k else batch.column(c) for c in range(batch.num_columns)], batch.schema.names)

        df = df.mapInArrow(run, schema)
    return df
