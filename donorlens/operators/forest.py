"""Random forests of fully grown classification trees, with out-of-bag votes.

Bags. A row is in a tree's bag ``k`` times, ``k`` Poisson(1) distributed by a hash of
(row key, tree, seed): any task, and SQL, draws the same bag, and a row's bag
needs no state. Rows with ``k = 0`` are out of bag for that tree.

Growth. All trees grow together. The rows are written once, in parts of a bounded
size, each row with its place in every tree's bag beside it. A node of more than
``TASK_ROWS`` rows is split by class weights per (feature, bin), bins being the table's
quantiles of each feature. One task counts them for a node and all large nodes
below it, from its rows' bins, a byte or two for each feature; where these bins take
more than ``CODED_BYTES``, the node is split by distributed sums instead, and its
halves are looked at again. Where no bin's edge can split a node, quantiles of the
node's own rows do. A smaller node is one task's group,
which finishes its subtree in memory: exact splits, until every leaf is pure or its
rows cannot be told apart. At each node the best split of ``mtry`` features in
random order is taken, of those that can split it.

The model is a table of subtrees, in Parquet: one row per subtree, its nodes as
arrays, and one table per level of the large nodes above them. Only these splits,
at most a few per ``TASK_ROWS`` rows of a bag, are read by every task. Rows are scored
where the trees are. Trees of up to ``WHOLE_NODES`` nodes are put together whole: blocks of
about ``WHOLE_ROWS`` rows, packed as matrices, are sent once for some trees at a time, and
out-of-bag rows once for each tree that permutes them. Larger trees stay apart: a task sends
its part down the large nodes of each tree and hands on the rows of each subtree as one
packed matrix; they meet the subtree in one group, dealt into blocks of about ``BLOCK_ROWS``
rows. So work and memory of a task are bounded at any size, and votes come back packed by part.

Partial dependence follows each row through each tree once: at a split on the
variable in question it takes both ways, each with the part of the grid that goes
there, and a leaf adds its vote to its part of the grid.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.operators.sampling import u01
from donorlens.session import staged

TASK_ROWS = 200_000
BLOCK_ROWS = 100_000
PART_ROWS = 16_384
BINS = 64  # quantiles of a node's own rows
FEW = 64  # rows of a node that are split as lists
GRID = 128  # quantiles of the whole table
MAX_LEVELS = 4_096  # factors of more levels are always summed by rows
CODED_BYTES = 96 << 20  # bins of one node's rows that a task holds
WHOLE_NODES = 300_000  # trees of no more nodes meet rows as a whole
WHOLE_ROWS = 200_000  # rows that meet some whole trees in a task
WHOLE_TREES = 10
WHOLE_BUCKETS = 4  # buckets of permuted rows that meet a whole tree in a task
_LOW = (1 << 32) - 1


# ---- bags ---------------------------------------------------------------------


def _steps() -> list[float]:
    """The Poisson(1) distribution; beyond 18 steps a 52-bit number cannot tell them apart."""
    steps, total = [], 0.0
    for k in range(18):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    return steps


_TURNS = [t for own in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in own * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_heads(blocks: np.ndarray) -> np.ndarray:
    """The first eight bytes of the MD5 digests of padded messages of one block, a row of 64 bytes each, as whole numbers."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    n = words.shape[1]
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v, np.uint32) for v in start)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # (b & c) | (~b & d)
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
            at = i
        elif i < 32:  # (d & b) | (~d & c)
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, f)
            f |= b
            f ^= c
            at = 7 * i % 16
        f += a
        f += words[at]
        f += np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(_TURNS[i]), g)
        f >>= np.uint32(32 - _TURNS[i])
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([a + start[0], b + start[1]], 1).astype("<u4").view(">u8").ravel().astype(np.uint64)


def _hash_heads(keys: list[bytes], ends: list[bytes]) -> np.ndarray:
    """The first eight bytes of the MD5 digest of each key followed by each end, a row per key."""
    out = np.empty((len(keys), len(ends)), np.uint64)
    sizes = np.array([len(k) for k in keys], np.int64)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        if size + max(map(len, ends)) > 55:  # more than a block
            for i in own.tolist():
                for t, end in enumerate(ends):
                    out[i, t] = int.from_bytes(hashlib.md5(keys[i] + end).digest()[:8])
            continue
        block = np.zeros((len(ends), 64), np.uint8)
        for t, end in enumerate(ends):
            tail = end + b"\x80"
            block[t, size:size + len(tail)] = list(tail)
            block[t, 56:58] = list((8 * (size + len(end))).to_bytes(2, "little"))
        text = np.frombuffer(b"".join(keys[i] for i in own.tolist()), np.uint8).reshape(len(own), size)
        step = max(1, 16384 // len(ends))  # messages whose words stay in the processor's cache
        for first in range(0, len(own), step):
            some = own[first:first + step]
            blocks = np.repeat(block[None], len(some), 0)
            blocks[:, :, :size] = text[first:first + step, None]
            out[some] = _md5_heads(blocks.reshape(-1, 64)).reshape(len(some), -1)
    return out


def drawn_bags(key: Column, trees: int, seed: int) -> Column:
    """The numbers of :func:`poisson_bags`, a whole row's at a time in Arrow batches: a fit draws them for all rows and trees."""
    steps, ends = np.array(_steps()), [f"|{seed}:bag:{t}".encode() for t in range(trees)]

    @F.arrow_udf("array<tinyint>")
    def drawn(keys: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int8)]
        for first in range(0, len(keys), 1000):
            heads = _hash_heads([k.encode() for k in keys[first:first + 1000].to_pylist()], ends)
            out.append(np.searchsorted(steps, (heads.ravel() >> 12) / 2.0**52, "right").astype(np.int8))
        places = pa.array(np.arange(len(keys) + 1) * trees, pa.int32())
        return pa.ListArray.from_arrays(places, pa.array(np.concatenate(out)))

    return drawn(F.coalesce(key.cast("string"), F.lit("\u0000NA")))


def poisson_bags(key: Column, trees: int, seed: int) -> Column:
    """How often a row is in each tree's bag, an array: Poisson(1), from the hash of ``key|seed:bag:tree``."""
    tree = F.sequence(F.lit(0), F.lit(trees - 1))
    # the hash is an array of its own, so that the steps below read it and do not repeat it
    u = F.transform(tree, lambda t: u01(key, F.concat(F.lit(f"{seed}:bag:"), t.cast("string"))))
    steps = _steps()

    def place(v: Column) -> Column:
        w = F.when(v < F.lit(steps[0]), 0)
        for k in range(1, 18):
            w = w.when(v < F.lit(steps[k]), k)
        return w.otherwise(18).cast("tinyint")

    return F.transform(u, place)


def with_trees(data: DataFrame, key: str, trees: int, seed: int) -> DataFrame:
    """Every row once per tree, with its place ``w`` in the tree's bag (0: out of bag)."""
    return data.select("*", F.posexplode(poisson_bags(F.col(key), trees, seed)).alias("tree", "w")).withColumn(
        "w", F.col("w").cast("int"))


def _parted(rows: DataFrame, n: int, bags: Column | None = None) -> DataFrame:
    """``rows`` written once in parts of about ``PART_ROWS`` rows, with the number of their ``part`` and
    their ``bags`` as ``w``, drawn after the deal, by all tasks alike."""
    sc = rows.sparkSession.sparkContext
    parts = max(math.ceil(n / min(PART_ROWS, BLOCK_ROWS)), min(sc.defaultParallelism, math.ceil(n / 1000)), 1)
    dealt = rows.repartition(parts, "rid").withColumn("part", F.spark_partition_id())
    return staged(dealt if bags is None else dealt.withColumn("w", bags), "parts")


def _bagged(data: DataFrame, key: str, n: int, trees: int, seed: int) -> DataFrame:
    """``(rid, y, x, part, w)``: the rows of ``data``, in parts, with their bags."""
    return _parted(data.select("rid", "y", "x", F.col(key).alias("key")), n, drawn_bags(F.col("key"), trees, seed)).drop("key")


# ---- one subtree in memory ----------------------------------------------------


def _best_cut(v: np.ndarray, w0: np.ndarray, w1: np.ndarray, nominal: bool):
    """(quality, threshold, left categories, left weights) of the best split of one feature, or None: the
    quality is the sum of squared class weights over the weight of both halves."""
    if nominal:  # categories in order of their share of class 1: one of the cuts of that order is best
        cats, at = np.unique(v, return_inverse=True)
        if len(cats) < 2:
            return None
        c0, c1 = np.bincount(at, w0), np.bincount(at, w1)
        order = np.lexsort((cats, c1 / (c0 + c1)))
        a0, a1 = c0[order].cumsum(), c1[order].cumsum()
        valid = np.arange(len(cats) - 1)
    else:
        order = np.argsort(v, kind="stable")
        s = v[order]
        valid = np.flatnonzero(s[1:] > s[:-1])
        if not len(valid):
            return None
        a0, a1 = w0[order].cumsum(), w1[order].cumsum()
    l0, l1 = a0[valid], a1[valid]
    r0, r1 = a0[-1] - l0, a1[-1] - l1
    q = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
    k = int(q.argmax())
    weights = float(l0[k]), float(l1[k])
    if nominal:
        return float(q[k]), None, np.sort(cats[order[:k + 1]]).astype(np.int64).tolist(), weights
    lo, hi = s[valid[k]], s[valid[k] + 1]
    mid = lo + (hi - lo) / 2
    return float(q[k]), float(mid if mid < hi else lo), None, weights


def _packed_columns(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list, list, list[int], int]:
    """``(keys, values, tops, shift)``: per feature one whole number for each row, the rank of its value among the
    feature's ``values`` above ``shift`` bits of weight and class, so that a plain sort brings all three into
    order; ``tops``: the rank of a missing number, larger than any."""
    shift = int(w.max(initial=0)).bit_length() + 1
    own = (w.astype(np.int64) << 1) | y
    keys, values, tops = [], [], []
    for f in range(x.shape[1]):
        v, rank = np.unique(x[:, f], return_inverse=True)
        narrow = (len(v) << shift) < 2**31
        keys.append(((rank.ravel() << shift) | own).astype(np.int32 if narrow else np.int64))
        values.append(v)
        tops.append(len(v) - int(np.isnan(v[-1:]).sum()))
    return keys, values, tops, shift


def _best_rank_cut(key: np.ndarray, top: int, shift: int, weights: np.ndarray, nominal: bool):
    """(quality, ranks on the left, left weights) of the best split of one feature, or None, from packed numbers: of a
    number the last rank on the left and the next one, of a factor all on the left. ``weights`` of the lower bits:
    that of both classes, and of class 1 in the upper half."""
    if nominal or top << shift <= len(key):  # few values: counted
        times = np.bincount(key)
        key = times.nonzero()[0]
        sums = weights[key & (len(weights) - 1)] * times[key]
    else:
        key.sort()
        sums = weights[key & (len(weights) - 1)]
    at = key >> shift
    ends = (at[1:] != at[:-1]).nonzero()[0]
    if not len(ends):
        return None
    sums = sums.cumsum()
    total = int(sums[-1])
    if nominal:  # categories in order of their share of class 1
        at, sums = at[np.r_[ends, -1]], np.diff(sums[np.r_[ends, -1]], prepend=0)
        order = np.lexsort((at, (sums >> 32) / (sums & _LOW)))
        at, sums, ends = at[order], sums[order].cumsum()[:-1], np.arange(len(at) - 1)
    else:
        if at[-1] == top:
            ends = ends[:-1]
            if not len(ends):
                return None
        sums = sums[ends]
    l1 = (sums >> 32).astype(float)
    l0 = (sums & _LOW) - l1
    t1 = total >> 32
    r0, r1 = ((total & _LOW) - t1) - l0, t1 - l1
    q = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
    k = int(q.argmax())
    cut = int(ends[k])
    return float(q[k]), at[:cut + 1] if nominal else (int(at[cut]), int(at[cut + 1])), (float(l0[k]), float(l1[k]))


def _best_rank_cut_of_few(keys: list, top: int, shift: int, nominal: bool, t0: int, t1: int):
    """The same for a few rows in a list, without the fixed cost of array operations; ``t0``, ``t1``: their class weights."""
    keys.sort()
    if keys[0] >> shift == keys[-1] >> shift:
        return None
    mask, steps = (1 << shift) - 1, []
    before, a, b = keys[0] >> shift, 0, 0
    for key in keys:  # class weights per rank
        rank = key >> shift
        if rank != before:
            steps.append((before, a, b))
            before, a, b = rank, 0, 0
        if key & 1:
            b += (key & mask) >> 1
        else:
            a += (key & mask) >> 1
    steps.append((before, a, b))
    if nominal:
        steps.sort(key=lambda s: (s[2] / (s[1] + s[2]), s[0]))
    elif steps[-1][0] >= top:
        steps.pop()
    l0 = l1 = 0
    best, at, weights = -1.0, -1, None
    for k in range(len(steps) - 1):
        _, a, b = steps[k]
        l0 += a
        l1 += b
        r0, r1 = t0 - l0, t1 - l1
        q = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
        if q > best:
            best, at, weights = q, k, (l0, l1)
    if at < 0:
        return None
    return best, [s[0] for s in steps[:at + 1]] if nominal else (steps[at][0], steps[at + 1][0]), weights


def _orders(rng: np.random.Generator, p: int):
    """Permutations of the features, one after the other: those of ``rng.permutation(p)``, drawn many at a time."""
    some = 64
    while True:
        yield from rng.permuted(np.broadcast_to(np.arange(p), (some, p)), axis=1).tolist()
        some = 4096


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, nominal: list[bool], mtry: int, seed: list[int],
         max_depth: int | None = None) -> dict[str, list]:
    """Columns of the nodes of a full tree, its root first; a leaf has ``feature`` -1."""
    orders = _orders(np.random.default_rng(seed), x.shape[1])
    out: dict[str, list] = {c: [] for c in ("feature", "threshold", "cats", "left", "right", "n0", "n1", "gain")}
    features, left, right = out["feature"], out["left"], out["right"]
    put = [out[c].append for c in out]
    keys, values, tops, shift = _packed_columns(x, y, w)
    low = np.arange(1 << shift)
    weights = (low >> 1) + ((low >> 1) * (low & 1) << 32)
    n1 = int(w[y == 1].sum(dtype=np.int64))
    # a node: its rows (of a few: places in lists of their own), depth, parent, side, class weights
    todo = [(np.arange(len(y)), None, 0, -1, None, int(w.sum(dtype=np.int64)) - n1, n1)]
    while todo:
        rows, few, depth, parent, side, n0, n1 = todo.pop()
        here = len(features)
        if parent >= 0:
            side[parent] = here
        best, quality = None, -1.0
        if n0 and n1 and (max_depth is None or depth < max_depth):
            if few is None and len(rows) <= FEW:
                few, rows = [k[rows].tolist() for k in keys], list(range(len(rows)))
            tried = 0
            for f in next(orders):
                if few is None:
                    cut = _best_rank_cut(keys[f][rows], tops[f], shift, weights, nominal[f])
                else:
                    own = few[f]
                    cut = _best_rank_cut_of_few([own[i] for i in rows], tops[f], shift, nominal[f], n0, n1)
                if cut:
                    tried += 1
                    if cut[0] > quality:
                        quality, best = cut[0], (f, cut)
                    if tried == mtry:
                        break
        if best is None:
            for one, value in zip(put, (-1, None, None, -1, -1, float(n0), float(n1), 0.0)):
                one(value)
            continue
        f, (q, ranks, (l0, l1)) = best
        t, cats = None, None
        if nominal[f]:
            cats = np.sort(values[f][ranks]).astype(np.int64).tolist()
        else:
            lo, hi = values[f][list(ranks)].tolist()
            mid = lo + (hi - lo) / 2
            t = mid if mid < hi else lo
        for one, value in zip(put, (f, t, cats, -1, -1, float(n0), float(n1), q - (n0 * n0 + n1 * n1) / (n0 + n1))):
            one(value)
        if few is None:
            own = keys[f][rows]
            go = np.isin(own >> shift, ranks) if nominal[f] else own < (ranks[0] + 1) << shift
            halves = rows[~go], rows[go]
        else:
            own = few[f]
            if nominal[f]:
                go = [own[i] >> shift in ranks for i in rows]
            else:
                edge = (ranks[0] + 1) << shift
                go = [own[i] < edge for i in rows]
            halves = [i for i, g in zip(rows, go) if not g], [i for i, g in zip(rows, go) if g]
        todo.append((halves[0], few, depth + 1, here, right, n0 - int(l0), n1 - int(l1)))
        todo.append((halves[1], few, depth + 1, here, left, int(l0), int(l1)))
    return out


class Subtree:
    """The nodes of one subtree (a row of arrays), or of several one after the other, as numpy arrays, to send rows down."""

    def __init__(self, packed: pa.Table):
        take = {c: _values(packed[c]) for c in ("feature", "threshold", "left", "right", "n0", "n1")}
        sizes = np.asarray(pc.list_value_length(packed["feature"].combine_chunks())).astype(np.int64)
        self.first, self.root = np.cumsum(sizes) - sizes, 0
        self.feature = take["feature"].astype(np.int64)
        self.left, self.right = (take[c].astype(np.int64) + np.repeat(self.first, sizes) for c in ("left", "right"))
        self.threshold = take["threshold"].astype(float)  # a null becomes NaN
        self.vote = (take["n1"] > take["n0"]).astype(np.int64)
        cats = packed["cats"].combine_chunks().flatten()
        self.nominal = np.asarray(cats.is_valid())
        self._hold(np.asarray(pc.list_parent_indices(cats)).astype(np.int64), np.asarray(cats.flatten()))

    def _hold(self, node: np.ndarray, cats: np.ndarray) -> None:
        self.width = 1 + int(cats.max(initial=0))
        self.held = np.sort(node * self.width + cats)

    @classmethod
    def whole(cls, packed: pa.Table, above: Upper) -> Subtree:
        """A whole tree: its subtrees and the splits above them."""
        out, tree = cls(packed), packed["tree"][0].as_py()
        ids, feature, threshold, child, nominal, cats = above.table(tree)
        place, n = dict(zip(packed["sub"].to_pylist(), out.first.tolist())), len(out.feature)
        if not len(ids):
            out.root = place[1]
            return out
        sides = np.array([[n + c if c >= 0 else place[2 * i + side] for side, c in enumerate(own)]
                          for i, own in zip(ids.tolist(), child.tolist())], np.int64)
        node, held = np.divmod(out.held, out.width)
        out._hold(np.concatenate([node, *[np.full(len(c), n + k) for k, c in cats.items()]]),
                  np.concatenate([held, *cats.values()]))
        out.feature, out.threshold = np.r_[out.feature, feature], np.r_[out.threshold, threshold]
        out.left, out.right = np.r_[out.left, sides[:, 0]], np.r_[out.right, sides[:, 1]]
        out.vote, out.nominal, out.root = np.r_[out.vote, np.zeros(len(ids), np.int64)], np.r_[out.nominal, nominal], n
        return out

    def goes_left(self, x: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        v = x[rows, self.feature[node]]
        with np.errstate(invalid="ignore"):
            go = v <= self.threshold[node]
        k = np.flatnonzero(self.nominal[node])
        if len(k):
            cat = v[k].astype(np.int64)
            key = node[k] * self.width + cat
            at = np.searchsorted(self.held, key)
            found = at < len(self.held)
            found[found] = self.held[at[found]] == key[found]
            go[k] = found & (cat >= 0) & (cat < self.width)
        return go

    def votes(self, x: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
        """The class of the leaf that each row reaches; ``used``: marked with the features that split it on its way."""
        out, rows, node = np.zeros(len(x), np.int64), np.arange(len(x)), np.full(len(x), self.root)
        while len(rows):
            inner = self.feature[node] >= 0
            out[rows[~inner]] = self.vote[node[~inner]]
            rows, node = rows[inner], node[inner]
            if used is not None:
                used[rows, self.feature[node]] = True
            node = np.where(self.goes_left(x, rows, node), self.left[node], self.right[node])
        return out

    def grid_votes(self, x: np.ndarray, var: int, grid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Votes for each grid value of feature ``var``, summed over the rows; row ``i`` is here for ``lo[i] <= g < hi[i]``."""
        steps = np.zeros(len(grid) + 1)
        rows, node, lo, hi = np.arange(len(x)), np.full(len(x), self.root), lo.copy(), hi.copy()
        cuts = np.searchsorted(grid, self.threshold, "right")  # grid values up to the threshold go left
        while len(rows):
            leaf = self.feature[node] < 0
            own = leaf & (self.vote[node] > 0)
            steps += np.bincount(lo[own], minlength=len(steps)) - np.bincount(hi[own], minlength=len(steps))
            rows, node, lo, hi = (a[~leaf] for a in (rows, node, lo, hi))
            i = np.flatnonzero(self.feature[node] == var)
            cut, split = cuts[node[i]], node[i]
            node = np.where(self.goes_left(x, rows, node), self.left[node], self.right[node])
            # a row at a split on the variable takes both ways, each with its part of the grid
            l_hi, r_lo = np.minimum(hi[i], cut), np.maximum(lo[i], cut)
            left, right = lo[i] < l_hi, r_lo < hi[i]
            both, far = left & right, hi[i]
            node[i] = np.where(left, self.left[split], self.right[split])
            lo[i], hi[i] = np.where(left, lo[i], r_lo), np.where(left, l_hi, far)
            if both.any():
                rows, node = np.r_[rows, rows[i][both]], np.r_[node, self.right[split][both]]
                lo, hi = np.r_[lo, r_lo[both]], np.r_[hi, far[both]]
        return steps.cumsum()[:-1]


# ---- the forest ---------------------------------------------------------------

_SPLIT = "feature int, threshold double, cats array<bigint>"
_CUTS = f"tree int, node bigint, {_SPLIT}, n0 double, n1 double, gain double"
_ARRAYS = ("feature", "threshold", "cats", "left", "right", "n0", "n1", "gain")
_PACKED = ("tree int, sub bigint, feature array<int>, threshold array<double>, cats array<array<bigint>>, "
           "`left` array<int>, `right` array<int>, n0 array<double>, n1 array<double>, gain array<double>")
_PACKED_SCHEMA = pa.schema([
    ("tree", pa.int32()), ("sub", pa.int64()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())),
    ("cats", pa.list_(pa.list_(pa.int64()))), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())),
    ("n0", pa.list_(pa.float64())), ("n1", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64()))])
_CUT_SCHEMA = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("threshold", pa.float64()),
                         ("cats", pa.list_(pa.int64())), ("n0", pa.float64()), ("n1", pa.float64()), ("gain", pa.float64())])


class Upper:
    """The splits of the large nodes, level by level, to send rows down each tree to its subtrees."""

    def __init__(self):
        self.levels: list[dict[int, tuple]] = []
        self.leaves: dict[int, list[int]] = {}
        self.flat: dict[int, tuple] = {}  # per tree its splits as one table, made when it is first asked for

    def add(self, splits: list) -> None:
        """Splits of any levels; those of nodes above them are here already."""
        by_depth: dict[int, list] = {}
        for r in splits:
            by_depth.setdefault(r["node"].bit_length(), []).append(r)
        for depth in sorted(by_depth):
            self._add(by_depth[depth])
        self.flat = {}

    def _add(self, splits: list) -> None:
        level: dict[int, list] = {}
        for r in splits:
            if r["feature"] < 0:
                self.leaves.setdefault(r["tree"], []).append(r["node"])
            else:
                level.setdefault(r["tree"], []).append(r)
        self.levels.append({tree: self._arrays(sorted(own, key=lambda r: r["node"])) for tree, own in level.items()})

    @staticmethod
    def _arrays(own: list) -> tuple:
        return (np.array([r["node"] for r in own], np.int64), np.array([r["feature"] for r in own], np.int64),
                np.array([np.nan if r["threshold"] is None else r["threshold"] for r in own], float),
                {k: np.array(r["cats"], np.int64) for k, r in enumerate(own) if r["cats"] is not None})

    def features(self, tree: int) -> set[int]:
        return {int(f) for level in self.levels if tree in level for f in level[tree][1]}

    def steps(self, tree: int, x: np.ndarray, node: np.ndarray, rows: np.ndarray):
        """Per level ``(i, feature, threshold, left)`` of the rows ``i`` that are at one of its nodes; ``node``
        and ``rows`` may be replaced between levels by the caller through the yielded list."""
        held = [node, rows]
        for level in self.levels:
            if tree not in level:
                continue
            ids, feature, threshold, cats = level[tree]
            at = np.minimum(np.searchsorted(ids, held[0]), len(ids) - 1)
            i = np.flatnonzero(ids[at] == held[0])
            at = at[i]
            v = x[held[1][i], feature[at]]
            with np.errstate(invalid="ignore"):
                left = v <= threshold[at]
            for k, own in cats.items():
                here = at == k
                left[here] = np.isin(v[here].astype(np.int64), own)
            yield held, i, feature[at], threshold[at], left

    def down(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node that each row of ``x`` reaches."""
        ids, feature, threshold, child, nominal, cats = self.table(tree)
        out = np.ones(len(x), np.int64)
        rows = np.arange(len(x) if len(ids) else 0)
        at = np.zeros(len(rows), np.int64)  # the root is the first
        while len(rows):
            v = x[rows, feature[at]]
            with np.errstate(invalid="ignore"):
                right = ~(v <= threshold[at])
            for k in np.unique(at[nominal[at]]).tolist():
                here = at == k
                right[here] = ~np.isin(v[here].astype(np.int64), cats[k])
            node, at = 2 * ids[at] + right, child[at, right.astype(np.int64)]
            done = at < 0
            out[rows[done]] = node[done]
            rows, at = rows[~done], at[~done]
        return out

    def table(self, tree: int) -> tuple:
        """``(ids, feature, threshold, child, nominal, cats)`` of a tree's splits, the root's first; ``child``: the
        places of both halves, -1 if not split here."""
        if tree not in self.flat:
            self.flat[tree] = self._table(tree)
        return self.flat[tree]

    def _table(self, tree: int) -> tuple:
        own = [level[tree] for level in self.levels if tree in level]
        if not own:
            return (np.zeros(0, np.int64),) * 6
        ids, feature, threshold = (np.concatenate([o[k] for o in own]) for k in range(3))
        ends = np.cumsum([0] + [len(o[0]) for o in own])
        cats = {int(first) + k: c for first, o in zip(ends, own) for k, c in o[3].items()}
        place = {n: k for k, n in enumerate(ids.tolist())}
        child = np.array([[place.get(2 * n, -1), place.get(2 * n + 1, -1)] for n in ids.tolist()], np.int64)
        nominal = np.zeros(len(ids), bool)
        nominal[list(cats)] = True
        return ids, feature, threshold, child, nominal, cats


@dataclass
class Forest:
    """``packed``: the subtrees, a row each; ``upper``: the splits of the large nodes above them, level by level."""

    features: list[str]
    trees: int
    seed: int
    packed: DataFrame
    upper: list[DataFrame] = field(default_factory=list)
    above: Upper = field(default_factory=Upper)
    bagged: DataFrame | None = None  # the training rows with their bags, written once
    held: int | None = None

    @property
    def largest(self) -> int:
        """The nodes of the largest tree, without those above its subtrees."""
        if self.held is None:
            size = self.packed.groupBy("tree").agg(F.sum(F.size("feature")).alias("n")).agg(F.max("n")).first()[0]
            self.held = int(size or 0)
        return self.held

    @property
    def nodes(self) -> DataFrame:
        """One row per node of a subtree, ``idx`` its number there."""
        each = F.posexplode(F.arrays_zip(*_ARRAYS)).alias("idx", "n")
        return self.packed.select("tree", "sub", each).select("tree", "sub", "idx", "n.*")


def _values(column) -> np.ndarray:
    """The values of an array column, one row after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _matrix(table, name: str = "x") -> np.ndarray:
    return _values(table[name]).reshape(len(table[name]), -1) if len(table[name]) else np.zeros((0, 1))


def _joined(column, dtype=np.float64, width: int | None = None) -> np.ndarray:
    """The packed numbers of a binary column, one blob after the other."""
    got = np.concatenate([np.frombuffer(b.as_buffer(), dtype) for b in column]) if len(column) else np.zeros(0, dtype)
    return got if width is None else got.reshape(-1, width)


def _by_node(node: np.ndarray):
    """``(node, its rows)`` for each node."""
    order = np.argsort(node, kind="stable")
    ids, first = np.unique(node[order], return_index=True)
    return zip(ids.tolist(), np.split(order, first[1:]))


def _sent(rows: DataFrame, made, schema: str) -> DataFrame:
    """Rows of ``made(part, columns)`` for every batch of each part, ``columns`` its numpy arrays."""
    names = rows.columns
    fields = pa.schema(_arrow(schema))

    def each(batches):
        for b in batches:
            if not b.num_rows:
                continue
            got = {c: _matrix(b, c) if pa.types.is_list(b.column(k).type) else b.column(k).to_numpy(zero_copy_only=False)
                   for k, c in enumerate(names)}
            for part in np.unique(got["part"]).tolist():
                own = got["part"] == part
                out = made(part, got if own.all() else {c: v[own] for c, v in got.items()})
                while out:  # a few blobs at a time
                    some, out = out[:256], out[256:]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), fields)], schema=fields)

    return rows.mapInArrow(each, schema)


def _arrow(schema: str) -> list:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
             "array<double>": pa.list_(pa.float64())}
    return [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]


def _spread(rows: DataFrame, trees: int, *keys: str) -> DataFrame:
    """Groups of a forest, a few per partition: they are large, so none waits behind many others."""
    return rows.repartition(max(2 * trees, rows.sparkSession.sparkContext.defaultParallelism), *keys)


# ---- growth -------------------------------------------------------------------


def _subtree_of(width: int, nominal: list[bool], mtry: int, seed: int, max_depth: int | None):
    def made(rows: pa.Table) -> pa.Table:
        tree, sub = rows["tree"][0].as_py(), rows["node"][0].as_py()
        depth = None if max_depth is None else max_depth - (sub.bit_length() - 1)
        x, y, w = _joined(rows["x"], width=width), _joined(rows["y"], np.int8), _joined(rows["w"], np.int8)
        got = grow(x, y, w, nominal, mtry, [seed, tree, sub], depth)
        return pa.table([[tree], [sub], *[[got[c]] for c in _ARRAYS]], schema=_PACKED_SCHEMA)

    return made


def _choice(cuts, mtry: int, n: int, rng: np.random.Generator):
    """``(feature, cut)`` of the best of ``mtry`` features in random order that can split, or None."""
    best, tried = None, 0
    for k in rng.permutation(n).tolist():
        cut = cuts(k)
        if cut:
            tried += 1
            if best is None or cut[0] > best[1][0]:
                best = (k, cut)
            if tried == mtry:
                break
    return best


def _best_of(nominal: list[bool], mtry: int, seed: int, max_depth: int | None):
    """The split of one large node from bins of its own: ``feature`` -1 where none of them can split it, or none may."""
    def made(bins: pa.Table) -> pa.Table:
        tree, node = bins["tree"][0].as_py(), bins["node"][0].as_py()
        f, v, w0, w1 = (bins[c].to_numpy() for c in ("f", "v", "w0", "w1"))
        first = f == f.min()
        n0, n1 = float(w0[first].sum()), float(w1[first].sum())
        may = n0 and n1 and (max_depth is None or node.bit_length() <= max_depth)

        def cuts(k):
            own = f == k
            return _best_cut(v[own], w0[own], w1[own], nominal[k])

        best = _choice(cuts, mtry, len(nominal), np.random.default_rng([seed, tree, node])) if may else None
        k, (q, t, cats, _) = best or (-1, (0.0, None, None, None))
        if best and t is not None:  # a bin stands for the values up to its upper edge
            t = float(v[(f == k) & (v <= t)].max())
        gain = q - (n0 * n0 + n1 * n1) / (n0 + n1) if best else 0.0
        return pa.table([[tree], [node], [k], [t], [cats], [n0], [n1], [gain]], schema=_CUT_SCHEMA)

    return made


def _large_splits(rows: DataFrame, nominal: list[bool], mtry: int, seed: int, max_depth: int | None) -> DataFrame:
    """The splits of large nodes from quantiles of each one's own rows."""
    held = rows.select("tree", "node", "y", "w", F.posexplode("x").alias("f", "v"))
    nom = [k for k, n in enumerate(nominal) if n]
    numeric = held.filter(~F.col("f").isin(nom)) if nom else held
    edges = F.percentile_approx("v", [k / BINS for k in range(1, BINS + 1)], 50 * BINS)
    edges = numeric.groupBy("tree", "node", "f").agg(F.array_distinct(edges).alias("edges"), F.max("v").alias("top"))
    up = F.when(F.col("edges").isNull(), F.col("v")).otherwise(F.coalesce(
        F.array_min(F.filter("edges", lambda e: e >= F.col("v"))), F.col("top")))
    bins = held.join(edges, ["tree", "node", "f"], "left").groupBy("tree", "node", "f", up.alias("v")).agg(
        F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).cast("double").alias("w0"),
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).cast("double").alias("w1"))
    return bins.groupBy("tree", "node").applyInArrow(_best_of(nominal, mtry, seed, max_depth), _CUTS)


@dataclass
class Grid:
    """Bins of the whole table: per numeric feature the upper edges, per factor its levels; ``first`` bin of each in a row of all."""

    edges: list[np.ndarray | None]
    first: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.first[f] + (x[:, f].astype(np.int64) if e is None else np.searchsorted(e, x[:, f]))
                                for f, e in enumerate(self.edges)])

    def packed(self, x: np.ndarray) -> np.ndarray:
        """The bins, each feature's from 0, as numbers of one or two bytes."""
        return (self.codes(x) - self.first[:-1]).astype(self.kind)

    @property
    def kind(self):
        return np.uint8 if np.diff(self.first).max(initial=0) <= 256 else np.uint16

    @property
    def row_bytes(self) -> int:
        """Of a row's bins, weight and class."""
        return np.dtype(self.kind).itemsize * len(self.edges) + 1


def _grid(rows: DataFrame, nominal: list[bool]) -> Grid | None:
    """The grid, or None where a factor has too many levels for it."""
    points = [k / GRID for k in range(1, GRID + 1)]
    got = rows.agg(*[F.max(F.get("x", F.lit(f))).alias(f"f{f}") if n else
                     F.percentile_approx(F.get("x", F.lit(f)), points, 50 * GRID).alias(f"f{f}")
                     for f, n in enumerate(nominal)]).first()
    if any(n and got[f] >= MAX_LEVELS for f, n in enumerate(nominal)):
        return None
    edges = [None if n else np.unique([e for e in got[f] if e == e]) for f, n in enumerate(nominal)]
    widths = [int(got[f]) + 1 if e is None else len(e) + 1 for f, e in enumerate(edges)]
    return Grid(edges, np.r_[0, np.cumsum(widths)])


def _grid_split(tree: int, node: int, n0: float, n1: float, sums, grid: Grid, nominal: list[bool], mtry: int, seed: int,
                max_depth: int | None) -> tuple[tuple, int]:
    """The split of a node (a row of ``_CUTS``) from ``sums(k)``, both class weights per bin of a feature, and the last
    bin on the left of a number's split; ``feature`` -2 where no edge of the grid can split the node, -1 where none may."""
    may = n0 and n1 and (max_depth is None or node.bit_length() <= max_depth)

    def cuts(k):
        own = sums(k)
        v = np.flatnonzero(own.sum(1))
        return _best_cut(v.astype(float), own[v, 0], own[v, 1], nominal[k])

    found = _choice(cuts, mtry, len(nominal), np.random.default_rng([seed, tree, node])) if may else None
    k, (q, t, cats, _) = found or (-2 if may else -1, (0.0, None, None, None))
    last = -1
    if found and t is not None:  # the cut lies at the upper edge of the last bin on the left
        last = int(np.flatnonzero(sums(k).sum(1)[:int(t) + 1])[-1])
        t = float(grid.edges[k][last])
    gain = q - (n0 * n0 + n1 * n1) / (n0 + n1) if found else 0.0
    return (tree, node, k, t, cats, n0, n1, gain), last


def _coded_splits(rows: DataFrame, large: list, above: Upper, grid: Grid, trees: int, nominal: list[bool], mtry: int,
                  seed: int, max_depth: int | None, task_rows: int) -> DataFrame:
    """The splits of large nodes and of all nodes of more than ``task_rows`` rows below them, as :func:`_grid_splits`
    finds them level by level: one task holds the bins of a node's rows."""
    wanted: dict[int, set] = {}
    for r in large:
        wanted.setdefault(r["tree"], set()).add(r["node"])

    def sent(part: int, d: dict) -> list:
        codes, out = grid.packed(d["x"]), []
        for tree, ids in wanted.items():
            w = d["w"][:, tree]
            own = np.flatnonzero(w)
            packed = (w[own] << 1 | d["y"][own]).astype(np.uint8)
            for node, at in _by_node(above.down(tree, d["x"][own])) if above.levels else ((1, slice(None)),):
                if node in ids:
                    out.append((tree, node, codes[own[at]].tobytes(), packed[at].tobytes()))
        return out

    def grown(blobs: pa.Table) -> pa.Table:
        tree, root = blobs["tree"][0].as_py(), blobs["node"][0].as_py()
        codes = np.ascontiguousarray(_joined(blobs["codes"], grid.kind, len(nominal)).T)
        packed = _joined(blobs["own"], np.uint8)
        place = np.arange(1 << 6)
        weight = np.stack([(place >> 1) * (place & 1 == c) for c in (0, 1)], 1).astype(float)  # per class, of a packed number
        widths, out, todo = np.diff(grid.first), [], [(root, None)]
        while todo:
            node, at = todo.pop()
            own = packed if at is None else packed[at]
            n0, n1 = (np.bincount(own, minlength=1 << 6) @ weight).tolist()
            held: dict[int, np.ndarray] = {}

            def sums(k):
                if k not in held:
                    code = (codes[k] if at is None else codes[k][at]).astype(np.int32)
                    code <<= 6
                    code |= own
                    held[k] = np.bincount(code, minlength=int(widths[k]) << 6).reshape(-1, 1 << 6) @ weight
                return held[k]

            split, last = _grid_split(tree, node, n0, n1, sums, grid, nominal, mtry, seed, max_depth)
            out.append(split)
            k = split[2]
            if k < 0:
                continue
            code = codes[k] if at is None else codes[k][at]
            go = np.isin(code, split[4]) if nominal[k] else code <= last
            for child, half in ((2 * node + 1, ~go), (2 * node, go)):
                if np.count_nonzero(half) > task_rows:
                    some = np.flatnonzero(half).astype(np.int32)
                    todo.append((child, some if at is None else at[some]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CUT_SCHEMA)], schema=_CUT_SCHEMA)

    coded = _sent(rows.select("part", "y", "w", "x"), sent, "tree int, node bigint, codes binary, own binary")
    return _spread(coded, trees, "tree", "node").groupBy("tree", "node").applyInArrow(grown, _CUTS)


def _grid_splits(rows: DataFrame, large: list, above: Upper, grid: Grid, trees: int, nominal: list[bool], mtry: int,
                 seed: int, max_depth: int | None) -> DataFrame:
    """The splits of large nodes from the grid's bins; ``feature`` -2 where no edge of the grid can split a node."""
    wanted: dict[int, np.ndarray] = {}
    for r in large:
        wanted.setdefault(r["tree"], []).append(r["node"])
    wanted = {t: np.sort(np.array(n, np.int64)) for t, n in wanted.items()}
    width, salts = int(grid.first[-1]), 16
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("salt", pa.int32()), ("sums", pa.binary())])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        salt = 0
        for b in batches:
            if not b.num_rows:
                continue
            x, w, y = _matrix(b), _matrix(b, "w"), b["y"].to_numpy()
            codes, salt = 2 * grid.codes(x) + y[:, None], b["part"][0].as_py() % salts
            for tree, ids in wanted.items():
                rows = np.flatnonzero(w[:, tree])
                node = above.down(tree, x[rows])
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                here = ids[at] == node
                rows, at = rows[here], at[here]
                cells = codes[rows] + (2 * width * at)[:, None]
                got = np.bincount(cells.ravel(), np.repeat(w[rows, tree], codes.shape[1]), 2 * width * len(ids))
                sums[tree] = sums[tree] + got if tree in sums else got
        for tree, total in sums.items():
            n = len(wanted[tree])
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * n, pa.int32()), pa.array(wanted[tree]), pa.array([salt] * n, pa.int32()),
                 pa.array([t.tobytes() for t in total.reshape(n, -1)], pa.binary())], schema=schema)

    def total(rows: pa.Table) -> np.ndarray:
        out = np.zeros(2 * width)
        for s in rows["sums"]:
            out += np.frombuffer(s.as_buffer())
        return out

    def merged(rows: pa.Table) -> pa.Table:
        return pa.table([rows["tree"][:1], rows["node"][:1], rows["salt"][:1], [total(rows).tobytes()]], schema=schema)

    def best(rows: pa.Table) -> pa.Table:
        tree, node, got = rows["tree"][0].as_py(), rows["node"][0].as_py(), total(rows).reshape(width, 2)
        n0, n1 = got[:grid.first[1]].sum(0).tolist()
        split, _ = _grid_split(tree, node, n0, n1, lambda k: got[grid.first[k]:grid.first[k + 1]], grid, nominal, mtry, seed, max_depth)
        return pa.table([[c] for c in split], schema=_CUT_SCHEMA)

    kind = "tree int, node bigint, salt int, sums binary"
    some = rows.select("part", "y", "w", "x").mapInArrow(added, kind)
    return some.groupBy("tree", "node", "salt").applyInArrow(merged, kind).groupBy("tree", "node").applyInArrow(best, _CUTS)


def _bag_rows(rows: DataFrame, nodes: list, above: Upper, width: int) -> DataFrame:
    """``(tree, node, y, w, x)``: the bag's rows of some large nodes, a row each."""
    wanted: dict[int, list] = {}
    for r in nodes:
        wanted.setdefault(r["tree"], []).append(r["node"])

    def made(part: int, d: dict) -> list:
        out = []
        for tree, ids in wanted.items():
            own = np.flatnonzero(d["w"][:, tree])
            node = above.down(tree, d["x"][own])
            here = np.isin(node, ids)
            out += [(tree, n, y, w, x) for n, y, w, x in zip(
                node[here].tolist(), d["y"][own[here]].tolist(), d["w"][own[here], tree].tolist(), d["x"][own[here]].tolist())]
        return out

    return _sent(rows.select("part", "y", "w", "x"), made, "tree int, node bigint, y int, w int, x array<double>")


def _sizes(rows: DataFrame, trees: int, above: Upper) -> DataFrame:
    """``(tree, node, size)``: the bag's rows at each node that has no split yet."""
    def made(part: int, d: dict) -> list:
        out = []
        for tree in range(trees):
            ids, n = np.unique(above.down(tree, d["x"][d["w"][:, tree] > 0]), return_counts=True)
            out += [(tree, i, k) for i, k in zip(ids.tolist(), n.tolist()) if i not in above.leaves.get(tree, ())]
        return out

    return _sent(rows.select("part", "w", "x"), made, "tree int, node bigint, n long").groupBy("tree", "node").agg(
        F.sum("n").alias("size"))


def fit(data: DataFrame, key: str, features: list[str], nominal: list[bool], trees: int, seed: int,
        mtry: int | None = None, max_depth: int | None = None, task_rows: int | None = None) -> Forest:
    """``data(key, rid, y, x)``: ``y`` 0 or 1, ``x`` an array of doubles without nulls (a nominal
    feature: its level's number), ``rid`` unique. No row gives a forest without nodes, which votes 0."""
    task_rows = task_rows or TASK_ROWS
    mtry = mtry or max(1, math.isqrt(len(features)))
    n = data.count()
    rows = _bagged(data, key, n, trees, seed)
    upper: list[DataFrame] = []
    above, leaves = Upper(), None
    grid = _grid(rows, nominal) if n > task_rows else None
    while upper or n > task_rows:
        # a row per large node: at most one in task_rows rows of a bag
        large = _sizes(rows, trees, above).filter(F.col("size") > task_rows).collect()
        if not large:
            break
        found, open_, more = None, large, True
        if grid:
            most = CODED_BYTES // grid.row_bytes
            small, wide = ([r for r in large if (r["size"] <= most) == held] for held in (True, False))
            some = [_coded_splits(rows, small, above, grid, trees, nominal, mtry, seed, max_depth, task_rows)] if small else []
            some += [_grid_splits(rows, wide, above, grid, trees, nominal, mtry, seed, max_depth)] if wide else []
            found = staged(reduce(DataFrame.unionByName, some), "splits")
            open_ = found.filter("feature = -2").select("tree", "node").collect()
            more = bool(open_ or wide)  # else every node left is a small one
            # the rows of an open node are found below the splits above it
            above.add(found.filter("feature > -2").collect())
            found = found.filter("feature > -2")
        if open_:
            own = staged(_large_splits(_bag_rows(rows, open_, above, len(nominal)), nominal, mtry, seed, max_depth), "splits")
            above.add(own.collect())
            found = own if found is None else found.unionByName(own)
        depths = sorted({len(f"{r['node']:b}") for r in found.select("node").collect()})
        upper += [found.filter(F.length(F.bin("node")) == depth) for depth in depths]
        own = found.filter("feature < 0").select(
            "tree", F.col("node").alias("sub"), *[F.array(c).alias(c) for c in ("feature", "threshold", "cats")],
            F.array(F.lit(-1)).alias("left"), F.array(F.lit(-1)).alias("right"),
            *[F.array(c).alias(c) for c in ("n0", "n1", "gain")])
        leaves = own if leaves is None else leaves.unionByName(own)
        if not more:
            break

    def sent(part: int, d: dict) -> list:
        out = []
        for tree in range(trees):
            own = np.flatnonzero(d["w"][:, tree])
            for node, at in _by_node(above.down(tree, d["x"][own])):
                if node not in above.leaves.get(tree, ()):
                    at = own[at]
                    out.append((tree, node, d["x"][at].tobytes(), d["y"][at].astype(np.int8).tobytes(),
                                d["w"][at, tree].astype(np.int8).tobytes()))
        return out

    bag = _sent(rows.select("part", "y", "w", "x"), sent, "tree int, node bigint, x binary, y binary, w binary")
    packed = _spread(bag, trees, "tree", "node").groupBy("tree", "node").applyInArrow(
        _subtree_of(len(nominal), nominal, mtry, seed, max_depth), _PACKED)
    packed = staged(packed if leaves is None else packed.unionByName(leaves), "subtrees")
    return Forest(features, trees, seed, packed, upper, above, rows)


# ---- rows meet the subtrees ----------------------------------------------------


def _met(forest: Forest, sizes: DataFrame, sent: DataFrame, function, schema: str) -> DataFrame:
    """``function(subtree, blobs)`` for the packed rows ``sent(tree, node, part, ...)`` at each subtree, in blocks
    of bounded size; ``sizes(tree, node, n)`` tells how many rows there are, in any number of rows."""
    blocks = staged(sizes.groupBy("tree", "node").agg(F.ceil(F.sum("n") / BLOCK_ROWS).cast("int").alias("blocks")), "blocks")
    held = forest.packed.select(*_NODES).join(
        blocks.withColumnRenamed("node", "sub"), ["tree", "sub"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    dealt = sent.join(F.broadcast(blocks), ["tree", "node"]).withColumn(
        "block", F.pmod(F.xxhash64("part", F.lit(3)), F.col("blocks"))).drop("blocks")
    dealt = dealt.withColumnsRenamed({"tree": "q_tree", "node": "q_node", "block": "q_block"})
    empty = pa.schema(_arrow(schema)).empty_table()

    def guarded(nodes: pa.Table, blobs: pa.Table) -> pa.Table:
        return function(Subtree(nodes), blobs) if len(blobs) and len(nodes) else empty

    parts = 4 * forest.trees
    return held.repartition(parts, "tree", "sub", "block").groupBy("tree", "sub", "block").cogroup(
        dealt.repartition(parts, "q_tree", "q_node", "q_block").groupBy("q_tree", "q_node", "q_block")).applyInArrow(
        guarded, schema)


_NODES = ("tree", "sub", "feature", "threshold", "cats", "left", "right", "n0", "n1")


def _each_tree(nodes: pa.Table, above: Upper):
    """``(tree, the whole tree)`` for the trees of a table of subtrees."""
    for tree in pc.unique(nodes["tree"]).sort().to_pylist():
        yield tree, Subtree.whole(nodes.filter(pc.equal(nodes["tree"], tree)), above)


def _met_whole(forest: Forest, nodes: DataFrame, sent: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """``function(nodes, blobs)`` for the packed rows ``sent(q_..., ...)`` and the subtrees that have the same ``keys``."""
    empty = pa.schema(_arrow(schema)).empty_table()

    def guarded(nodes: pa.Table, blobs: pa.Table) -> pa.Table:
        return function(nodes, blobs) if len(blobs) and len(nodes) else empty

    parts, q_keys = 4 * forest.trees, [f"q_{k}" for k in keys]
    return nodes.repartition(parts, *keys).groupBy(*keys).cogroup(
        sent.repartition(parts, *q_keys).groupBy(*q_keys)).applyInArrow(guarded, schema)


def _some_trees(forest: Forest, n: int) -> tuple[DataFrame, int, int, int]:
    """``(nodes, blocks, groups, per)``: the subtrees in ``groups`` of ``per`` trees, once for each of ``blocks`` blocks of ``n`` rows.

    With ``WHOLE_NODES`` nodes a tree at most, the copies of the trees take no more room than rows would
    that are sent to each tree.
    """
    per = max(1, min(WHOLE_TREES, 2 * WHOLE_NODES // max(1, forest.largest)))
    blocks = max(1, math.ceil(n / WHOLE_ROWS))
    nodes = forest.packed.select(*_NODES, F.floor(F.col("tree") / per).cast("int").alias("some"),
                                 F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return nodes, blocks, math.ceil(forest.trees / per), per


def _whole_votes(forest: Forest, rows: DataFrame, bagged: bool, n: int) -> DataFrame:
    """:func:`_votes` where some whole trees at a time meet the rows: a row is sent once for all of them."""
    above, width, trees = forest.above, len(forest.features), forest.trees
    nodes, blocks, groups, per = _some_trees(forest, n)

    def send(part: int, d: dict) -> list:
        rid, x = d["rid"].tobytes(), d["x"].tobytes()
        return [(some, part % blocks, part, rid, x,
                 (d["w"][:, some * per:(some + 1) * per] == 0).tobytes() if bagged else b"") for some in range(groups)]

    def function(nodes: pa.Table, blobs: pa.Table) -> pa.Table:
        x = _joined(blobs["x"], width=width)
        first = nodes["some"][0].as_py() * per
        out = _joined(blobs["out"], np.bool_, min(per, trees - first)) if bagged else None
        votes, seen = np.zeros(len(x), np.int8), np.zeros(len(x), np.int8)
        for tree, whole in _each_tree(nodes, above):
            own = np.flatnonzero(out[:, tree - first]) if bagged else slice(None)
            votes[own] += whole.votes(x[own]).astype(np.int8)
            seen[own] += 1
        ends = np.cumsum([len(r.as_buffer()) // 8 for r in blobs["rid"]])[:-1]
        packed = [pa.array([v.tobytes() for v in np.split(c, ends)], pa.binary()) for c in (votes, seen)]
        return pa.table([blobs["part"], blobs["rid"], *packed], names=["part", "rid", "votes", "trees"])

    def added(blobs: pa.Table) -> pa.Table:
        rid, at = np.unique(_joined(blobs["rid"], np.int64), return_inverse=True)
        votes, seen = (np.bincount(at, _joined(blobs[c], np.int8), len(rid)).astype(np.int64) for c in ("votes", "trees"))
        held = seen > 0
        return pa.table({"rid": rid[held], "votes": votes[held], "trees": seen[held]})

    sent = _sent(rows, send, "q_some int, q_block int, part int, rid binary, x binary, out binary")
    got = _met_whole(forest, nodes, sent, ["some", "block"], function, "part int, rid binary, votes binary, trees binary")
    return got.groupBy("part").applyInArrow(added, "rid long, votes long, trees long")


def _votes(forest: Forest, rows: DataFrame, bagged: bool, n: int) -> DataFrame:
    """``rows(rid, x, part[, w])``, ``n`` of them -> ``(rid, votes, trees)``: the classes of the leaves that each row
    reaches in the trees (``bagged``: in those whose bag does not hold it), added up."""
    if forest.largest <= WHOLE_NODES:
        return _whole_votes(forest, rows, bagged, n)
    above, trees, width = forest.above, forest.trees, len(forest.features)

    def reached(d: dict):
        for tree in range(trees):
            own = np.flatnonzero(d["w"][:, tree] == 0) if bagged else np.arange(len(d["x"]))
            for node, at in _by_node(above.down(tree, d["x"][own])) if len(own) else ():
                yield tree, node, own[at]

    def count(part: int, d: dict) -> list:
        return [(tree, node, len(at)) for tree, node, at in reached(d)]

    def send(part: int, d: dict) -> list:
        return [(tree, node, part, d["rid"][at].tobytes(), d["x"][at].tobytes()) for tree, node, at in reached(d)]

    def function(subtree: Subtree, blobs: pa.Table) -> pa.Table:
        votes = subtree.votes(_joined(blobs["x"], width=width)).astype(np.int8)
        ends = np.cumsum([len(r.as_buffer()) // 8 for r in blobs["rid"]])
        return pa.table({"part": blobs["part"], "rid": blobs["rid"],
                         "vote": pa.array([v.tobytes() for v in np.split(votes, ends[:-1])], pa.binary())})

    def added(blobs: pa.Table) -> pa.Table:
        rid, at = np.unique(_joined(blobs["rid"], np.int64), return_inverse=True)
        return pa.table({"rid": rid, "votes": np.bincount(at, _joined(blobs["vote"], np.int8)).astype(np.int64),
                         "trees": np.bincount(at).astype(np.int64)})

    sizes = _sent(rows, count, "tree int, node bigint, n long")
    sent = _sent(rows, send, "tree int, node bigint, part int, rid binary, x binary")
    got = _met(forest, sizes, sent, function, "part int, rid binary, vote binary")
    return got.groupBy("part").applyInArrow(added, "rid long, votes long, trees long")


def scores(forest: Forest, data: DataFrame) -> DataFrame:
    """``data(rid, x)`` -> ``(rid, votes, trees)``: votes for class 1 over all trees."""
    n = data.count()
    return _votes(forest, _parted(data.select("rid", "x"), n), False, n)


def out_of_bag(forest: Forest, data: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """``(rid, votes, trees)`` for the training rows: votes of the trees whose bag does not hold
    the row (``trees`` of them, 0 if all hold it). Without ``data``, for the rows and bags that the fit has written."""
    own = data is None
    data = forest.bagged if own else data
    n = data.count()
    rows = data if own else _bagged(data.select("rid", F.lit(0).alias("y"), "x", key), key, n, forest.trees, forest.seed)
    got = _votes(forest, rows.select("rid", "x", "part", "w"), True, n)
    zero = F.lit(0).cast("long")
    return data.select("rid").join(got, "rid", "left").select(
        "rid", F.coalesce("votes", zero).alias("votes"), F.coalesce("trees", zero).alias("trees"))


def gini_importance(forest: Forest) -> DataFrame:
    """``(variable, mean_decrease_gini)``: per feature the decrease of weighted Gini impurity at
    its splits, summed over each tree's nodes and averaged over the trees."""
    each = F.explode(F.arrays_zip("feature", "gain")).alias("n")
    every = forest.packed.select(each).select("n.*")
    for splits in forest.upper:
        every = every.unionByName(splits.select("feature", "gain"))
    per = every.filter("feature >= 0").groupBy("feature").agg((F.sum("gain") / forest.trees).alias("g"))
    names = forest.packed.sparkSession.createDataFrame(list(enumerate(forest.features)), "feature int, variable string")
    return names.join(per, "feature", "left").select(
        "variable", F.coalesce("g", F.lit(0.0)).alias("mean_decrease_gini")).orderBy(
        F.desc("mean_decrease_gini"), "variable")


def _moved(x: np.ndarray, seed: list[int]) -> np.ndarray:
    """Each column moved along the rows by a step of its own, drawn."""
    rng, n = np.random.default_rng(seed), len(x)
    return np.column_stack([np.roll(x[:, f], int(rng.integers(1, n)) if n > 1 else 0) for f in range(x.shape[1])])


def _shifted(features: int, seed: int):
    """:func:`_moved` written out, as the tests read it. Rows of one tree's bucket, in an order drawn by hash: one copy as it is (variant -1) and one per
    feature with that feature's values moved along the order by a drawn step."""
    def made(part: pa.Table) -> pa.Table:
        part = part.sort_by([("h", "ascending"), ("rid", "ascending")])
        x, n = _matrix(part), len(part)
        tree, bucket = part["tree"][0].as_py(), part["bucket"][0].as_py()
        moved, out = _moved(x, [seed, tree, bucket]), [x]
        for f in range(features):
            copy = x.copy()
            copy[:, f] = moved[:, f]
            out.append(copy)
        flat = np.concatenate(out)
        ends = pa.array(np.arange(len(flat) + 1) * x.shape[1], pa.int32())
        copies = features + 1
        return pa.table({"tree": pa.array(np.full(len(flat), tree, np.int32)),
                         "rid": pa.array(np.tile(part["rid"].to_numpy(), copies)),
                         "variant": pa.array(np.repeat(np.arange(-1, features, dtype=np.int32), n)),
                         "x": pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))})

    return made


def permutation_importance(forest: Forest, data: DataFrame | None = None, key: str | None = None,
                           rows_per_bucket: int | None = None) -> DataFrame:
    """``(variable, mean_decrease_accuracy, sd, class0_decrease, class1_decrease, trees)``.

    Per tree and feature: the accuracy on the tree's out-of-bag rows less that with
    the feature's values permuted among them; mean and standard deviation over the trees.
    A tree's rows are permuted within hash buckets of about ``rows_per_bucket``. Without
    ``data``, of the rows and bags that the fit has written.
    """
    rows_per_bucket = rows_per_bucket or BLOCK_ROWS
    n = (forest.bagged if data is None else data).count()
    buckets = max(1, math.ceil(n * 0.4 / rows_per_bucket))
    trees, seed, above, width = forest.trees, forest.seed, forest.above, len(forest.features)
    rows = forest.bagged if data is None else _bagged(data, key, n, trees, seed)
    if forest.largest <= WHOLE_NODES:
        return _decreases(forest, _whole_permuted(forest, rows, buckets))
    rows = rows.withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64("rid", t, F.lit(seed))))

    def send(part: int, d: dict) -> list:
        out = []
        for tree in range(trees):
            own = np.flatnonzero(d["w"][:, tree] == 0)
            for bucket, at in _by_node(d["h"][own, tree] % buckets) if len(own) else ():
                at = own[at]
                out.append((tree, bucket, *[a.tobytes() for a in (d["h"][at, tree], d["rid"][at], d["y"][at].astype(np.int8), d["x"][at])]))
        return out

    def shifted(blobs: pa.Table) -> pa.Table:
        """A bucket's rows with their permuted values beside their own (``p``), packed by the subtrees that any
        of a row's copies reaches; ``here``: which copies do, the unchanged one first."""
        tree, bucket = blobs["tree"][0].as_py(), blobs["bucket"][0].as_py()
        h, rid, y = (_joined(blobs[c], k) for c, k in (("h", np.int64), ("rid", np.int64), ("y", np.int8)))
        order = np.lexsort((rid, h))
        x, y = _joined(blobs["x"], width=width)[order], y[order]
        p = _moved(x, [seed, tree, bucket])
        nodes = np.repeat(above.down(tree, x)[:, None], width + 1, axis=1)
        for f in above.features(tree):
            copy = x.copy()
            copy[:, f] = p[:, f]
            nodes[:, f + 1] = above.down(tree, copy)
        out = []
        for node in np.unique(nodes).tolist():
            here = nodes == node
            for at in np.array_split(np.flatnonzero(here.any(1)), math.ceil(len(x) / PART_ROWS)):
                out.append((tree, node, bucket, len(at), *[a.tobytes() for a in (x[at], p[at], y[at], here[at])]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    def function(subtree: Subtree, blobs: pa.Table) -> pa.Table:
        out = {}
        for blob in range(len(blobs)):
            one = blobs.slice(blob, 1)
            x, p = (_joined(one[c], width=width) for c in ("x", "p"))
            y, here = _joined(one["y"], np.int8), _joined(one["here"], np.bool_, width + 1)
            for variant in range(-1, width):
                at = np.flatnonzero(here[:, variant + 1])
                copy = x[at]
                if variant >= 0:
                    copy[:, variant] = p[at, variant]
                right = subtree.votes(copy) == y[at]
                for c in (0, 1):
                    got = out.setdefault((variant, c), [0, 0])
                    own = y[at] == c
                    got[0] += int(own.sum())
                    got[1] += int(right[own].sum())
        tree = one["q_tree"][0].as_py()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*[(tree, v, c, n, r) for (v, c), (n, r) in out.items()]), (
            pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["tree", "variant", "y", "n", "right"])

    kind = "tree int, node bigint, part int, n long, x binary, p binary, y binary, here binary"
    fields = pa.schema(_arrow(kind))
    sent = _sent(rows, send, "tree int, bucket int, h binary, rid binary, y binary, x binary")
    made = _spread(sent, trees, "tree", "bucket").groupBy("tree", "bucket").applyInArrow(shifted, kind)
    # written once: the blobs are counted before they meet the subtrees
    made = staged(made, "variants")
    return _decreases(forest, _met(forest, made.select("tree", "node", "n"), made.drop("n"), function, _RIGHT))


_RIGHT = "tree int, variant int, y int, n long, right long"


def _row_hashes(rid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The numbers of ``xxhash64(rid, tree, seed)`` in SQL."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v, k):
        return v << np.uint64(k) | v >> np.uint64(64 - k)

    def mixed(v):
        v = (v ^ v >> np.uint64(33)) * p2
        v = (v ^ v >> np.uint64(29)) * p3
        return v ^ v >> np.uint64(32)

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = mixed(turned(h ^ turned(rid.astype(np.uint64) * p2, 31) * p1, 27) * p1 + p4)
        for number in (tree, seed):
            h = mixed(turned((h + p5 + np.uint64(4)) ^ np.uint64(number & _LOW) * p1, 23) * p2 + p3)
    return h.astype(np.int64)


def _whole_permuted(forest: Forest, rows: DataFrame, buckets: int) -> DataFrame:
    """How many rows each tree has right, by class, with each feature permuted (``variant`` -1: with none): a tree's
    out-of-bag rows are sent once, and meet all of it. A row's vote can change only by a feature that splits it on its way."""
    trees, seed, above, width = forest.trees, forest.seed, forest.above, len(forest.features)
    chunks = math.ceil(buckets / WHOLE_BUCKETS)

    def send(part: int, d: dict) -> list:
        out = []
        for tree in range(trees):
            own = np.flatnonzero(d["w"][:, tree] == 0)
            chunk = _row_hashes(d["rid"][own], tree, seed) % buckets // WHOLE_BUCKETS
            for c, at in _by_node(chunk) if len(own) else ():
                at = own[at]
                out.append((tree, c, d["rid"][at].tobytes(), d["y"][at].astype(np.int8).tobytes(), d["x"][at].tobytes()))
        return out

    def function(nodes: pa.Table, blobs: pa.Table) -> pa.Table:
        (tree, whole), = _each_tree(nodes, above)
        rid, y, x = _joined(blobs["rid"], np.int64), _joined(blobs["y"], np.int8), _joined(blobs["x"], width=width)
        h, out = _row_hashes(rid, tree, seed), {}
        for bucket, at in _by_node(h % buckets):
            at = at[np.lexsort((rid[at], h[at]))]
            own, classes = x[at], y[at]
            moved, used = _moved(own, [seed, tree, bucket]), np.zeros((len(at), width), bool)
            base = whole.votes(own, used)
            for variant in range(-1, width):
                got = base
                if variant >= 0:
                    some = np.flatnonzero(used[:, variant] & (moved[:, variant] != own[:, variant]))
                    copy, got = own[some], base.copy()
                    copy[:, variant] = moved[some, variant]
                    got[some] = whole.votes(copy)
                for c in (0, 1):
                    counts, held = out.setdefault((variant, c), [0, 0]), classes == c
                    counts[0] += int(held.sum())
                    counts[1] += int((got[held] == c).sum())
        return pa.Table.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*[(tree, v, c, n, r) for (v, c), (n, r) in out.items()]),
                                                                       _arrow(_RIGHT))], schema=pa.schema(_arrow(_RIGHT)))

    nodes = forest.packed.select(*_NODES, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    sent = _sent(rows.select("part", "rid", "y", "w", "x"), send, "q_tree int, q_chunk int, rid binary, y binary, x binary")
    return _met_whole(forest, nodes, sent, ["tree", "chunk"], function, _RIGHT)


def _decreases(forest: Forest, votes: DataFrame) -> DataFrame:
    """The table of :func:`permutation_importance` from counts of right votes."""
    def rate(*classes: int) -> Column:
        own = F.col("y").isin(*classes)
        return F.try_divide(F.sum(F.when(own, F.col("right"))), F.sum(F.when(own, F.col("n"))))

    by_tree = votes.groupBy("tree", "variant").agg(rate(0, 1).alias("a"), rate(0).alias("a0"), rate(1).alias("a1"))
    by_tree = staged(by_tree, "accuracies")
    base = by_tree.filter("variant = -1").select("tree", *[F.col(c).alias(f"b_{c}") for c in ("a", "a0", "a1")])
    d = by_tree.filter("variant >= 0").join(base, "tree").groupBy("variant").agg(
        F.avg(F.col("b_a") - F.col("a")).alias("mean_decrease_accuracy"),
        F.stddev_samp(F.col("b_a") - F.col("a")).alias("sd"),
        F.avg(F.col("b_a0") - F.col("a0")).alias("class0_decrease"),
        F.avg(F.col("b_a1") - F.col("a1")).alias("class1_decrease"), F.count(F.lit(1)).alias("trees"))
    names = votes.sparkSession.createDataFrame(list(enumerate(forest.features)), "variant int, variable string")
    return names.join(d, "variant", "left").drop("variant")


def partial_dependence(forest: Forest, data: DataFrame, var: str, grid: list[float]) -> DataFrame:
    """``(value, yhat)``: for each grid value the mean share of trees that vote for class 1 when
    the numeric feature ``var`` has that value in all rows of ``data(rid, x)``. ``grid`` ascends."""
    k, points = forest.features.index(var), np.array(grid)
    above, width, n = forest.above, len(forest.features), data.count()
    rows = _parted(data.select("rid", "x"), n)

    def shares(sums: DataFrame) -> DataFrame:
        values = data.sparkSession.createDataFrame(list(enumerate(map(float, grid))), "at int, value double")
        return values.join(sums.groupBy("at").agg(F.sum("votes").alias("v")), "at", "left").select(
            "value", (F.coalesce("v", F.lit(0.0)) / F.lit(float(max(n, 1) * forest.trees))).alias("yhat"))

    if forest.largest <= WHOLE_NODES:
        return shares(_whole_grid(forest, rows, k, points, n))

    def reached(d: dict):
        """Per tree and subtree its rows, each with the part of the grid that it stands for."""
        x = d["x"]
        for tree in range(forest_trees):
            row, lo = np.arange(len(x)), np.zeros(len(x), np.int64)
            hi, node = np.full(len(x), len(points)), np.ones(len(x), np.int64)
            for held, i, feature, threshold, left in above.steps(tree, x, node, row):
                node, row = held
                # both ways at splits on the variable, each with its part of the grid
                own, cut = feature == k, np.searchsorted(points, threshold, "right")
                l_hi = np.where(own, np.minimum(hi[i], cut), np.where(left, hi[i], lo[i]))
                r_lo = np.where(own, np.maximum(lo[i], cut), np.where(left, hi[i], lo[i]))
                rest = np.ones(len(row), bool)
                rest[i] = False
                l, r = lo[i] < l_hi, r_lo < hi[i]
                node = np.r_[node[rest], 2 * node[i][l], 2 * node[i][r] + 1]
                lo, hi = np.r_[lo[rest], lo[i][l], r_lo[r]], np.r_[hi[rest], l_hi[l], hi[i][r]]
                row = np.r_[row[rest], row[i][l], row[i][r]]
                held[:] = node, row
            for at_node, at in _by_node(node):
                yield tree, at_node, row[at], lo[at], hi[at]

    def count(part: int, d: dict) -> list:
        return [(tree, node, len(row)) for tree, node, row, _, _ in reached(d)]

    def send(part: int, d: dict) -> list:
        return [(tree, node, part, d["x"][row].tobytes(), lo.tobytes(), hi.tobytes()) for tree, node, row, lo, hi in reached(d)]

    def function(subtree: Subtree, blobs: pa.Table) -> pa.Table:
        got = np.zeros(len(points))
        for blob in range(len(blobs)):
            one = blobs.slice(blob, 1)
            got += subtree.grid_votes(_joined(one["x"], width=width), k, points, *[_joined(one[c], np.int64) for c in ("lo", "hi")])
        return pa.table({"at": pa.array(np.arange(len(points), dtype=np.int32)), "votes": got})

    forest_trees = forest.trees
    sizes = _sent(rows, count, "tree int, node bigint, n long")
    sent = _sent(rows, send, "tree int, node bigint, part int, x binary, lo binary, hi binary")
    return shares(_met(forest, sizes, sent, function, "at int, votes double"))


def _whole_grid(forest: Forest, rows: DataFrame, k: int, points: np.ndarray, n: int) -> DataFrame:
    """``(at, votes)``: votes for each grid value of feature ``k`` over the rows and trees, in parts; whole trees meet the rows."""
    above, width = forest.above, len(forest.features)
    nodes, blocks, groups, _ = _some_trees(forest, n)

    def send(part: int, d: dict) -> list:
        x = d["x"].tobytes()
        return [(some, part % blocks, x) for some in range(groups)]

    def function(nodes: pa.Table, blobs: pa.Table) -> pa.Table:
        x, got = _joined(blobs["x"], width=width), np.zeros(len(points))
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), len(points))
        for _, whole in _each_tree(nodes, above):
            got += whole.grid_votes(x, k, points, lo, hi)
        return pa.table({"at": pa.array(np.arange(len(points), dtype=np.int32)), "votes": got})

    sent = _sent(rows, send, "q_some int, q_block int, x binary")
    return _met_whole(forest, nodes, sent, ["some", "block"], function, "at int, votes double")
