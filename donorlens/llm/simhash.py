"""SimHash near-duplicates found with BK-trees over fingerprint shards.

Fingerprint: the text is lower-cased (A-Z), cut into words at ASCII white
space and into ``k``-word shingles (repeats included); a bit is 1 if it is set
in more than half of the shingles' XXH64 hashes.

Search: two fingerprints within ``radius`` bits agree wholly on at least
``blocks - radius`` of ``blocks`` bit blocks, so every combination of that many
blocks is a table, and a shard is one value of one table. Each shard gets a
BK-tree: a child hangs from its parent under their Hamming distance ``e``, and
a query at distance ``d`` from a node follows only the edges with
``|e - d| <= radius``. A shard's members are both its tree and its queries. A
shard of more than ``tree_rows`` fingerprints is dealt into several bounded
trees, each of which is sent to every query block of that shard (at most
``tree_rows`` fingerprints, so what is copied has a fixed bound); no pair of
fingerprints is lost by that. All trees of one Arrow batch are built and
searched together, level by level, with numpy.

A task reports only a spanning forest of the links that it finds, so a group
of n near copies costs n edges, not n^2. Links become groups by distributed
connected components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import staged
from donorlens.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 5
TREE_ROWS = 16384
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(data: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text in UTF-8 (null or wordless: 0)."""
    import xxhash

    words = data.translate(_LOWER).split() if data else ()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.fromiter(map(len, words), np.int64, n)
        ends = ends.cumsum() + np.arange(n)
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[:n - k + 1].tolist(), ends[k - 1:].tolist())]
    h = np.array(hashes, np.uint64)
    # per byte position a histogram of byte values; then the bits of each value
    at = h.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
    ones = counts @ _VALUE_BITS  # byte position x bit
    bits = (2 * ones > len(h)).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


_VALUE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_column(col, k: int = SHINGLE_WORDS):
    """The fingerprint of a text column as a signed long, computed in Arrow batches."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        got = [fingerprint(t, k) for t in texts.cast(pa.large_binary()).to_pylist()]
        return pa.array(np.array(got, np.uint64).view(np.int64))

    return fp(col)


# ---- BK-forest of one batch of shards ---------------------------------------


class Forest:
    """One BK-tree per shard; ``cell`` numbers the shards of ``fps`` from 0, sorted."""

    def __init__(self, cell: np.ndarray, fps: np.ndarray, cells: int):
        self.fps = fps
        n = len(fps)
        self.child = np.full((n, 65), -1, np.int32)
        self.root = np.full(cells, -1, np.int64)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, np.int64)
        self.root[cell[first]] = first
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[cell[rest]]
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
            open_ = self.child[at, d] < 0
            _, new = np.unique((at * 65 + d)[open_], return_index=True)
            new = np.flatnonzero(open_)[new]
            self.child[at[new], d[new]] = rest[new]
            at = self.child[at, d].astype(np.int64)
            down = np.ones(len(rest), bool)
            down[new] = False
            rest, at = rest[down], at[down]

    def near(self, queries: np.ndarray, cell: np.ndarray, radius: int, most: int = 400_000):
        """Yield (query row, node) arrays within ``radius``; the frontier is cut at ``most``."""
        q = np.arange(len(queries))
        node = self.root[cell]
        todo = [(q[i:i + 16384], node[i:i + 16384]) for i in range(0, len(q), 16384)]
        while todo:
            q, node = todo.pop()
            live = node >= 0
            q, node = q[live], node[live]
            if len(q) > most:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            if not len(q):
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            steps = d[:, None] + np.arange(-radius, radius + 1)
            inside = (steps >= 1) & (steps <= 64)
            kids = np.where(inside, self.child[node[:, None], np.clip(steps, 0, 64)], -1)
            row, col = np.nonzero(kids >= 0)
            if len(row):
                todo.append((q[row], kids[row, col].astype(np.int64)))


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs (a, b) in the pointer array ``parent``."""
    while True:
        a, b = parent[a], parent[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def batch_links(cell: np.ndarray, tree: np.ndarray, fps: np.ndarray, radius: int) -> tuple:
    """Spanning forest of the links between the tree rows and the query rows of each cell.

    ``tree`` is 1 for a tree row, 0 for a row that only asks, 2 for both.
    """
    cells, cell = np.unique(cell, return_inverse=True)
    grows = np.flatnonzero(tree >= 1)
    asks = np.flatnonzero(tree != 1)
    forest = Forest(cell[grows], fps[grows], len(cells))
    parent = np.arange(len(fps))
    for q, node in forest.near(fps[asks], cell[asks], radius):
        _merge(parent, asks[q], grows[node])
    joined = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[joined], fps[parent[joined]]


def _search(radius: int, batch_rows: int = 60_000):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[tuple] = []

        def links(rows):
            cell, tree, fps = (np.concatenate(x) for x in zip(*rows))
            a, b = batch_links(cell, tree, fps.view(np.uint64), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)

        size = 0
        for batch in batches:
            cell, tree, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(cell):
                continue
            if size >= batch_rows and cell[0] != held[-1][0][-1]:
                yield links(held)
                held, size = [], 0
            held.append((cell, tree, fps))
            size += len(cell)
            if size >= batch_rows:  # up to the last cell that has certainly ended
                c, t, f = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(c, c[-1]))
                if cut:
                    yield links([(c[:cut], t[:cut], f[:cut])])
                held, size = [(c[cut:], t[cut:], f[cut:])], len(c) - cut
        if held:
            yield links(held)

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
                      tree_rows: int = TREE_ROWS) -> DataFrame:
    """``fps(fp long)``, distinct -> edges ``(a, b)`` that connect exactly the
    fingerprints which a chain of steps of at most ``radius`` bits connects."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    masks = []
    for tables in combinations(range(blocks), blocks - radius):
        bits = sum(((1 << int(edges[t + 1])) - (1 << int(edges[t]))) for t in tables)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    tabled = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                        .alias("t", "part"))
    sizes = tabled.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.withColumn("trees", F.ceil(F.col("n") / tree_rows).cast("int")).drop("n")
    member = tabled.join(sizes, ["t", "part"])
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("trees")).cast("int")
    # cell (i, j), i <= j: the members of block i ask the tree of block j
    asks = F.transform(F.sequence(F.col("own"), F.col("trees") - 1), lambda j: F.struct(
        F.col("own").alias("i"), j.alias("j"), F.when(j == F.col("own"), 2).otherwise(0).alias("tree")))
    grows = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("own") - 1, F.lit(0))),
                                                 lambda i: F.struct(i.alias("i"), F.col("own").alias("j"),
                                                                    F.lit(1).alias("tree"))))
    cells = (member.withColumn("own", own)
             .withColumn("c", F.explode(F.concat(asks, F.coalesce(grows, F.array().cast(
                 "array<struct<i:int,j:int,tree:int>>")))))
             .select(F.xxhash64("t", "part", "c.i", "c.j").alias("cell"), F.col("c.tree").alias("tree"), "fp"))
    found = (cells.repartition("cell").sortWithinPartitions("cell")
             .mapInArrow(_search(radius), "a long, b long"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    k: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int = BLOCKS,
                    tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest id that chains of near-duplicate links
    reach. A null or wordless text has fingerprint zero and is linked like any
    other; rows with a null id take part, and a group without any id has
    component null. Repeated rows and exact copies share a fingerprint, which
    is searched once. Other columns of ``docs`` are ignored.
    """
    own = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), k).alias("fp")),
                 "fingerprints")
    rep = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of = _least_of_component(rep, radius, blocks, tree_rows)
    return own.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def _least_of_component(rep: DataFrame, radius: int, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``rep(fp, least)``, one row per fingerprint, with the smallest ``least`` of each fingerprint's component."""
    comp = connected_components(fingerprint_links(rep.select("fp"), radius, blocks, tree_rows))
    # only linked fingerprints need another value than their own
    linked = comp.select(F.col("vertex").alias("fp"), "root").union(
        comp.select(F.col("root").alias("fp"), "root").distinct())
    least = linked.join(rep, "fp").groupBy("root").agg(F.min("least").alias("least_of_root"))
    moved = linked.join(least, "root").select("fp", "least_of_root", F.lit(True).alias("linked"))
    # written out, so that both sides of the next join have a plain exchange and AQE can split a hot fingerprint
    return staged(rep.join(moved, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("least_of_root")).otherwise(F.col("least")).alias("least")), "components")


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id, rows without id last,
    of several with that id the one of the smallest text hash.

    Rows that repeat an id with other texts are rows of their own groups. Exact
    repeats of the row that stays are kept once; where they differ in further
    columns, the smallest values stay. Null and wordless texts form a group. An
    empty table gives no row.
    """
    texts = docs.select("doc_id", "text")
    own = staged(texts.select("doc_id", F.xxhash64("text").alias("th"), fingerprint_column(F.col("text"), k).alias("fp")),
                 "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    rep = staged(own.groupBy("fp").agg(F.min(place).alias("least")), "distinct")
    stays = _least_of_component(rep, radius).select("least.doc_id", "least.th").distinct()
    stays = stays.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.xxhash64("text").alias("th"), F.col("doc_id").alias("id")).join(
        stays, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left_semi")
    return kept.groupBy("id", "th").agg(F.min("row").alias("row")).select("row.*")
