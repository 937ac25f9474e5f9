"""Exact top-k inner-product search with vector-approximation files.

Every vector becomes whole numbers, ``floor(scale * x)`` per component. The range
of each component over all candidates is cut into ``2 ** bits`` cells of equal
width, and a vector's approximation is one byte per component: its cells.

1. Scan. Candidates' approximations and queries are dealt into blocks of bounded
   size, and every query block meets every candidate block once (the stated query
   set against all rows, in blocks). A score lies within the query's product with
   the middles of the cells, give or take the query's own sum over the half widths:
   one matrix product bounds a block. Candidates whose upper bound lies under the
   k-th best lower bound of their block are passed over.
2. Threshold. The k-th best lower bound over all blocks rules out most of the rest.
3. Exact vectors. Those of the ``2 k`` best upper bounds of each query are read
   first; their k-th exact score is a sharper threshold, and only candidates whose
   upper bound reaches it are read as well. Then the result is certain.

So exact vectors meet queries only where a bound leaves the result open; what is
copied to the query blocks is the approximation. Bounds (doubled) and scores are
sums of whole numbers below 2^53 and therefore exact in double precision; larger
vectors are bounded and scored in 64-bit integers, and values whose scores could
exceed those raise an error instead of a wrong result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import staged

K = 20
SCALE = 64
BITS = 6
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 8192
_SCAN = 256  # queries scanned together within a block


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  scale: int = SCALE) -> DataFrame:
    """``(vec_id, row_id, dim, v array<long>)``; vectors that are null, empty or hold a null or
    non-finite component, and rows without id, take no part. Every row has a ``row_id`` of its own."""
    x = F.col(vector_col)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (
        F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return (vectors.filter(F.col(id_col).isNotNull() & good).select(F.col(id_col).alias("vec_id"), v.alias("v"))
            .withColumn("dim", F.size("v")).withColumn("row_id", F.monotonically_increasing_id()))


def cell_width(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers per cell of each component."""
    return np.maximum(1, -(-(high - low + 1) // (1 << bits)))


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(middle, slack)``: twice the score of a query and a candidate lies within ``middle`` (query x
    candidate) give or take ``slack`` (per query)."""
    middle = 2 * (low + cells.astype(np.int64) * width) + width - 1  # of the first and last number of the cell, doubled
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(middle).max(initial=0) + width.max(initial=0)) * len(low)
    if most >= 2 ** 63:
        raise ValueError("vector components are too large for a long score")
    kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
    return queries.astype(kind) @ middle.astype(kind).T, np.abs(queries) @ (width - 1)


def scan_block(queries: np.ndarray, query_rows: np.ndarray, cells: np.ndarray, rows: np.ndarray, low: np.ndarray,
               width: np.ndarray, k: int):
    """Rows (query position, candidate position, doubled lower bound, doubled upper bound) of one pair of blocks that the block alone does not rule out."""
    out: list[tuple] = []
    for at in range(0, len(queries), _SCAN):
        middle, slack = bounds(queries[at:at + _SCAN], cells, low, width)
        own = query_rows[at:at + _SCAN, None] == rows[None, :]
        least = middle.min(initial=0) - 1
        middle = np.where(own, least, middle)
        # the slack of a query is the same for all candidates: the k-th lower bound is that of the k-th middle
        kth = np.partition(middle, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(middle), least)
        i, j = np.nonzero((middle + 2 * slack[:, None] >= kth[:, None]) & ~own)
        m = middle[i, j].astype(np.int64)
        out.append((at + i, j, m - slack[i], m + slack[i]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _packed(bits: int):
    kind = np.uint8 if bits <= 8 else np.uint16

    @F.arrow_udf("binary")
    def cells(v: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        out = []
        for x, lo, hi in zip(v.to_pylist(), low.to_pylist(), high.to_pylist()):
            lo = np.array(lo, np.int64)
            out.append(((np.array(x, np.int64) - lo) // cell_width(lo, np.array(hi, np.int64), bits)).astype(kind).tobytes())
        return pa.array(out, pa.binary())

    return cells(F.col("v"), F.col("lo"), F.col("hi")), kind


_BOUNDS = pa.schema([("q_row", pa.int64()), ("row_id", pa.int64()), ("lower", pa.int64()), ("upper", pa.int64())])


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, bits: int = BITS,
          id_col: str = "vec_id", vector_col: str = "embedding", candidate_block: int = CANDIDATE_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of every query row.

    ``is_query`` is a condition on ``vec_id``. A query's candidates are all other
    rows with vectors of its length, those that repeat its id or vector included;
    fewer than ``k`` of them are all returned. Ties go to the smaller id. An empty
    table gives no row.
    """
    table = staged(whole_vectors(vectors, id_col, vector_col, scale), "vectors")
    shape = table.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    blocks = shape.filter("q > 0").select(
        "dim", F.ceil(F.col("n") / candidate_block).cast("int").alias("nc"),
        F.ceil(F.col("q") / query_block).cast("int").alias("nq"))
    ranges = (table.select("dim", F.posexplode("v").alias("c", "x")).groupBy("dim", "c")
              .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
              .groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("c", "lo", "hi"))).alias("r"))
              .select("dim", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")))  # two numbers a component
    blocks = staged(blocks.join(ranges, "dim"), "blocks")
    spread = F.xxhash64("row_id")
    packed, kind = _packed(bits)
    cand = (table.join(blocks, "dim").select("dim", "nq", F.pmod(spread, F.col("nc")).cast("int").alias("cb"), "row_id",
                                             packed.alias("cells"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq"))
    ask = (table.filter(is_query).join(blocks, "dim").withColumn("qb", F.pmod(spread, F.col("nq")).cast("int"))
           .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
           .select(F.col("dim").alias("q_dim"), F.col("cb").alias("q_cb"), F.col("qb").alias("q_qb"),
                   F.col("row_id").alias("q_row"), F.col("v").alias("q"), "lo", "hi"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _BOUNDS.empty_table()
        low, high = (np.array(right[c][0].as_py(), np.int64) for c in ("lo", "hi"))
        queries = right["q"].combine_chunks().flatten().to_numpy().reshape(len(right), -1)
        cells = np.frombuffer(b"".join(left["cells"].to_pylist()), kind).reshape(len(left), -1)
        rows, query_rows = left["row_id"].to_numpy(), right["q_row"].to_numpy()
        q, n, lower, upper = scan_block(queries, query_rows, cells, rows, low, cell_width(low, high, bits), k)
        return pa.table([query_rows[q], rows[n], lower, upper], schema=_BOUNDS)

    open_ = staged(cand.groupBy("dim", "cb", "qb").cogroup(ask.groupBy("q_dim", "q_cb", "q_qb")).applyInArrow(
        pair, "q_row long, row_id long, lower long, upper long"), "open")

    def kth_of(rows: DataFrame, value: str) -> DataFrame:
        best = Window.partitionBy("q_row").orderBy(F.desc(value))
        top = rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
        return top.groupBy("q_row").agg(F.min(F.when(F.col("nth") == k, F.col(value))).alias("kth"))

    def read(rows: DataFrame) -> DataFrame:
        """With ids and exact scores."""
        found = table.select("row_id", "vec_id", "v")
        asked = table.filter(is_query).select(F.col("row_id").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        products = F.zip_with("q", "v", lambda a, b: a * b)
        score = F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x)
        return rows.join(found, "row_id").join(asked, "q_row").select("q_row", "query_id", "row_id", "vec_id", score.alias("score"))

    left = open_.join(kth_of(open_, "lower"), "q_row").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("kth")
    first = Window.partitionBy("q_row").orderBy(F.desc("upper"), "row_id")
    left = staged(left.withColumn("nth", F.row_number().over(first)), "left")
    sure = staged(read(left.filter(F.col("nth") <= 2 * k).select("q_row", "row_id")), "read")
    sharper = kth_of(sure, "score")
    rest = left.filter(F.col("nth") > 2 * k).join(sharper, "q_row").filter(
        F.col("kth").isNull() | (F.col("upper") >= 2 * F.col("kth"))).select("q_row", "row_id")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return (sure.unionByName(read(rest)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
