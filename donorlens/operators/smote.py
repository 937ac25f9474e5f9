"""SMOTE (synthetic minority over-sampling) as Spark jobs.

Semantics of ``SMOTE(form, data, perc.over, perc.under, k = 5)``:

* distances between minority cases: squared differences of the numeric
  predictors scaled by their range over the minority cases, plus 1 for each
  nominal predictor that differs;
* for each minority case, ``perc.over / 100`` synthetic cases: pick one of its
  ``k`` nearest minority neighbours at random (of all of them, if there are
  fewer); numeric values are ``x + gap * (neighbour - x)`` with one uniform
  ``gap`` per synthetic case, a nominal value is taken from either parent at
  random; with ``perc.over`` under 100 that share of the minority cases, drawn
  at random, gets one synthetic case each;
* ``perc.under / 100 * n_synthetic`` majority cases drawn with replacement;
* result = drawn majority + original minority + synthetic cases.

Randomness is hash-seeded (identical on retries and at any partitioning).

Exact k nearest neighbours
--------------------------
1. identical feature vectors are merged into one weighted point;
2. space is cut into cells of about ``CELL_POINTS`` points by recursive median
   splits along the widest dimension, planned on a bounded sample (eight points
   a cell, at most ``MAX_CELLS`` cells); every point is assigned, and the exact
   bounding box of each cell's points is taken from all of them;
3. inside each cell every point finds its k nearest and the distance d of the
   k-th: an upper bound of its true k-th distance;
4. a point visits exactly the other cells whose box is no farther than d (cells
   are first ruled out box against box), and each visit keeps at most k
   candidates before anything is shuffled;
5. the best k of all kept candidates are the exact neighbours, ties by id.

Nothing is capped or sampled in the search itself. How many cells a point
visits depends on the data's intrinsic dimension, not on its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlens.operators.sampling import exact_split, sample_with_replacement, u01
from donorlens.session import materialize

CELL_POINTS = 256
MAX_CELLS = 50_000
SAMPLE_PER_CELL = 8

_POINT = "_vid string, _mult long, z array<double>, n array<string>, cell int"
_HIT = "_vid string, _nvid string, _d2 double, _nm long"


def _vector_key(numeric, nominal):
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                                          for c in list(numeric) + list(nominal)]), 256)


def _points(minority: DataFrame, numeric, nominal, key: str) -> DataFrame:
    """``(_vkey, _vid, _mult, z, n)``: distinct vectors, named by their smallest case key;
    ``z`` the numeric values over their range (0 for a constant column)."""
    ranges = minority.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numeric]).first() if numeric else {}
    z = F.array(*[F.col(c).cast("double") / F.lit(ranges[c]) if ranges[c] else F.lit(0.0) for c in numeric]).cast(
        "array<double>")
    n = F.array(*[F.col(c).cast("string") for c in nominal]).cast("array<string>")
    return (minority.select(_vector_key(numeric, nominal).alias("_vkey"), F.col(key).cast("string").alias("_key"),
                            z.alias("z"), n.alias("n"))
            .groupBy("_vkey").agg(F.min("_key").alias("_vid"), F.count(F.lit(1)).alias("_mult"),
                                  F.first("z").alias("z"), F.first("n").alias("n")))


def _plan_cells(sample: np.ndarray, cells: int) -> list[tuple]:
    """Split nodes ``(dimension, threshold, left, right)``; a negative child is the leaf ``-1 - child``."""
    nodes: list = []
    leaves = 0

    def build(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        spread = np.ptp(points, axis=0) if len(points) and points.shape[1] else np.zeros(0)
        if want <= 1 or not len(spread) or spread.max() <= 0:
            leaves += 1
            return -leaves
        dim = int(spread.argmax())
        cut = float(np.median(points[:, dim]))
        low = points[:, dim] < cut
        if not low.any():  # the median is the smallest value: keep it alone on the left
            cut = float(np.nextafter(cut, np.inf))
            low = points[:, dim] < cut
        at = len(nodes)
        nodes.append(None)
        left = build(points[low], want // 2)
        nodes[at] = (dim, cut, left, build(points[~low], want - want // 2))
        return at

    root = build(sample, cells)
    return nodes if root >= 0 else []


def _cell_of(nodes: list[tuple], z: np.ndarray) -> np.ndarray:
    at = np.zeros(len(z), np.int64) if nodes else np.full(len(z), -1)
    while (live := np.flatnonzero(at >= 0)).size:
        table = np.array([n[:1] + n[2:] for n in nodes], np.int64)
        cuts = np.array([n[1] for n in nodes])
        node = at[live]
        low = z[live, table[node, 0]] < cuts[node]
        at[live] = np.where(low, table[node, 1], table[node, 2])
    return -1 - at


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64).reshape(len(col), -1)


def _nearest(a_id, a_z, a_n, b_id, b_mult, b_z, b_n, k: int, within: np.ndarray | None = None) -> pd.DataFrame:
    """Per row of ``a`` the nearest rows of ``b``, until they stand for ``k`` cases."""
    of, near_id, dist, mult = [], [], [], []
    step = max(1, 2_000_000 // max(1, len(b_id)))
    for s in range(0, len(a_id), step):
        e = min(len(a_id), s + step)
        d2 = np.zeros((e - s, len(b_id)))
        for c in range(a_z.shape[1]):
            d2 += (a_z[s:e, c, None] - b_z[None, :, c]) ** 2
        for c in range(a_n.shape[1] if a_n.ndim > 1 else 0):
            d2 += (a_n[s:e, c, None] != b_n[None, :, c]).astype(float)
        keep = a_id[s:e, None] != b_id[None, :]
        if within is not None:
            keep &= d2 <= within[s:e, None]
        for i in range(e - s):
            j = np.flatnonzero(keep[i])
            if len(j) > 4 * k:
                near = j[np.argpartition(d2[i, j], k - 1)[:k]]
                j = j[d2[i, j] <= d2[i, near].max()]
            j = j[np.lexsort((b_id[j], d2[i, j]))]
            if len(j):
                before = np.cumsum(b_mult[j]) - b_mult[j]
                j = j[before < k]
                of += [a_id[s + i]] * len(j)
                near_id += b_id[j].tolist()
                dist += d2[i, j].tolist()
                mult += b_mult[j].tolist()
    return _hits(of, near_id, dist, mult)


def _hits(of: list, near: list, dist: list, mult: list) -> pd.DataFrame:
    return pd.DataFrame({"_vid": pd.Series(of, dtype=object), "_nvid": pd.Series(near, dtype=object),
                         "_d2": pd.Series(dist, dtype="float64"), "_nm": pd.Series(mult, dtype="int64")})


def _arrays(pdf: pd.DataFrame):
    n = np.array([["\0" if x is None else x for x in v] for v in pdf["n"]], object).reshape(len(pdf), -1)
    return pdf["_vid"].to_numpy(object), _matrix(pdf["z"]), n


def visits(pts: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """``(visited, _vid, _mult, z, n, d)``: the cells beside its own that each point must look into."""
    boxes = (pts.select("cell", F.posexplode("z").alias("c", "x")).groupBy("cell", "c")
             .agg(F.min("x").alias("lo"), F.max("x").alias("hi")).groupBy("cell")
             .agg(F.array_sort(F.collect_list(F.struct("c", "lo", "hi"))).alias("r"))
             .select("cell", "r.lo", "r.hi").collect())  # a row per cell, at most MAX_CELLS
    cell = np.array([b["cell"] for b in boxes], np.int64)
    low, high = (np.array([b[x] for b in boxes], np.float64).reshape(len(boxes), -1) for x in ("lo", "hi"))
    kth = first.groupBy("_vid").agg(F.max("_d2").alias("far"), F.sum("_nm").alias("got"))
    d = F.when(F.col("got") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    own = pts.join(kth, "_vid", "left").withColumn("d", F.coalesce(d, F.lit(float("inf"))))

    def look(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, z, _ = _arrays(pdf)
        d = pdf["d"].to_numpy()
        inside_low, inside_high = z.min(0), z.max(0)
        gap = np.maximum(0, np.maximum(low - inside_high, inside_low - high))
        near = np.flatnonzero(((gap ** 2).sum(1) * (1 - 1e-12) <= d.max()) & (cell != key[0]))
        rows, cells = [], []
        for b in near.tolist():
            gap = np.maximum(0, np.maximum(low[b] - z, z - high[b]))
            hit = np.flatnonzero((gap ** 2).sum(1) * (1 - 1e-12) <= d)
            rows.append(hit)
            cells.append(np.full(len(hit), cell[b]))
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        out = pdf.iloc[at][["_vid", "z", "n", "d"]].astype({"_vid": object})
        return out.assign(visited=np.concatenate(cells) if cells else np.zeros(0, np.int64))

    return own.groupBy("cell").applyInPandas(look, "visited int, _vid string, z array<double>, n array<string>, d double")


def cells_of(pts: DataFrame, cell_points: int = CELL_POINTS, max_cells: int = MAX_CELLS) -> DataFrame:
    """``pts`` with the number of its cell, written once."""
    n = pts.count()
    cells = min(max_cells, max(1, math.ceil(n / cell_points)))
    nodes: list[tuple] = []
    if cells > 1:
        sample = pts.orderBy(F.xxhash64("_vid")).limit(SAMPLE_PER_CELL * cells).select("z").collect()
        nodes = _plan_cells(np.array([r["z"] for r in sample], np.float64).reshape(len(sample), -1), cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=_cell_of(nodes, _matrix(pdf["z"])))

    return materialize(pts.select("_vid", "_mult", "z", "n").mapInPandas(assign, _POINT))


def first_pass(pts: DataFrame, k: int) -> DataFrame:
    """Each point's nearest in its own cell, its own duplicates first."""

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, z, n = _arrays(pdf)
        mult = pdf["_mult"].to_numpy()
        many = np.flatnonzero(mult > 1)
        same = _hits(ids[many].tolist(), ids[many].tolist(), [0.0] * len(many), (mult[many] - 1).tolist())
        return pd.concat([same, _nearest(ids, z, n, ids, mult, z, n, k)])

    found = pts.groupBy("cell").applyInPandas(inside, _HIT)
    return materialize(_best(found, k))


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The candidates of each point, nearest first, until they stand for ``k`` cases."""
    w = Window.partitionBy("_vid").orderBy("_d2", "_nvid").rowsBetween(Window.unboundedPreceding, -1)
    c = hits.withColumn("_before", F.coalesce(F.sum("_nm").over(w), F.lit(0)))
    return c.filter(F.col("_before") < k)


def knn(minority: DataFrame, numeric, nominal, k: int = 5, key: str = "donor", cell_points: int = CELL_POINTS):
    """Exact k nearest neighbours among the minority cases (with multiplicities).

    Returns ``(pairs, names)``: one row ``(_vid, _nvid, _d2, _nm, _before)`` per (point,
    neighbour point), where ``_before`` is the number of neighbour cases closer in
    the order (a point's own duplicates come first, at distance 0), and the
    points with ``_vkey`` and ``_vid``.
    """
    named = materialize(_points(minority, numeric, nominal, key))
    pts = cells_of(named, cell_points)
    first = first_pass(pts, k)
    other = pts.select(F.col("cell").alias("own"), F.col("_vid").alias("b_id"), F.col("_mult").alias("b_mult"),
                       F.col("z").alias("b_z"), F.col("n").alias("b_n"))

    def meet(asks: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(cell):
            return _hits([], [], [], [])
        ids, z, n = _arrays(asks)
        b = cell.rename(columns={"b_id": "_vid", "b_z": "z", "b_n": "n"})
        b_id, b_z, b_n = _arrays(b)
        return _nearest(ids, z, n, b_id, cell["b_mult"].to_numpy(), b_z, b_n, k, asks["d"].to_numpy())

    far = (visits(pts, first, k).groupBy("visited").cogroup(other.groupBy("own")).applyInPandas(meet, _HIT))
    return materialize(_best(first.drop("_before").unionByName(far), k)), named.select("_vkey", "_vid")


def _minority(train: DataFrame, label: str) -> tuple:
    counts = {r[label]: r["c"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()}
    least = min(counts, key=lambda c: (counts[c], str(c)))
    return train.filter(F.col(label) == least), train.filter(F.col(label) != least), counts[least]


def smote(train: DataFrame, label: str, numeric: list[str], nominal: list[str], perc_over: int = 1600,
          perc_under: int = 100, k: int = 5, seed: int = 1287, key: str = "donor") -> DataFrame:
    """Balanced training set: drawn majority + minority + synthetic minority cases.

    Adds a column ``origin`` (``majority`` / ``minority`` / ``synthetic``).
    Synthetic cases get the key ``<parent key>#<n>``.
    """
    minority, majority, m = _minority(train, label)
    if m < 2:
        raise ValueError("SMOTE needs at least two minority cases: there is no neighbour to interpolate with")
    n_new, parents, n_parents = perc_over // 100, minority, m
    if perc_over < 100:
        n_new, n_parents = 1, math.floor(m * perc_over / 100)
        parents = exact_split(minority, key, perc_over / 100, seed)[0]
    nn, names = knn(minority, numeric, nominal, k, key)
    choice = min(k, m - 1)  # with few cases all others are neighbours
    rows = parents.withColumn("_vkey", _vector_key(numeric, nominal)).join(names, "_vkey")
    draws = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_new))).alias("_n"))
    rk = F.concat_ws("#", F.col(key).cast("string"), F.col("_n").cast("string"))
    draws = (draws.withColumn("_j", (F.floor(u01(rk, f"{seed}:nn") * choice) + 1).cast("long"))
                  .withColumn("_gap", u01(rk, f"{seed}:gap"))
                  .withColumn("_coin", u01(rk, f"{seed}:nom")))
    near = nn.select(F.col("_vid").alias("_of"), "_nvid", "_before", "_nm")
    pick = draws.join(near, (F.col("_vid") == F.col("_of")) & (F.col("_j") > F.col("_before"))
                      & (F.col("_j") <= F.col("_before") + F.col("_nm")), "inner").drop("_of", "_vkey", "_vid")
    # neighbour values: the case that names the neighbour vector
    rep = minority.select(F.col(key).cast("string").alias("_nvid"),
                          *[F.col(c).alias(f"_nb_{c}") for c in numeric + nominal])
    syn = pick.join(rep, "_nvid")
    out_cols = []
    for c in train.columns:
        if c in numeric:
            x, nb = F.col(c).cast("double"), F.col(f"_nb_{c}").cast("double")
            out_cols.append((x + F.col("_gap") * (nb - x)).alias(c))
        elif c in nominal:
            out_cols.append(F.when(F.col("_coin") < 0.5, F.col(f"_nb_{c}")).otherwise(F.col(c)).alias(c))
        elif c == key:
            out_cols.append(rk.alias(c))
        else:
            out_cols.append(F.col(c))
    synthetic = syn.select(*out_cols)
    drawn = sample_with_replacement(majority, int(perc_under / 100 * n_parents * n_new), seed, key)
    if "_draw" in drawn.columns:
        drawn = drawn.withColumn(key, F.concat_ws("#", F.col(key), F.lit("draw"), F.col("_draw").cast("string")))
    base_types = {c: ("double" if c in numeric else train.schema[c].dataType) for c in train.columns}

    def norm(df, origin):
        return df.select(*[F.col(c).cast(base_types[c]).alias(c) for c in train.columns],
                         F.lit(origin).alias("origin"))
    return norm(drawn, "majority").unionByName(norm(minority, "minority")).unionByName(norm(synthetic, "synthetic"))


def neighbour_distances(train: DataFrame, label: str, numeric, nominal, k: int = 5, key: str = "donor") -> DataFrame:
    """Squared scaled distance to the 1st..k-th nearest minority neighbour, per minority case."""
    minority, _, _ = _minority(train, label)
    nn, names = knn(minority, numeric, nominal, k, key)
    rows = minority.select(key, _vector_key(numeric, nominal).alias("_vkey")).join(names, "_vkey")
    ranks = rows.select(key, "_vid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    near = nn.withColumnRenamed("_vid", "_of")
    j = ranks.join(near, (F.col("_vid") == F.col("_of")) & (F.col("rank") > F.col("_before"))
                   & (F.col("rank") <= F.col("_before") + F.col("_nm")))
    return j.select(F.col(key), F.col("rank").cast("int").alias("rank"), F.col("_d2").alias("distance"))
