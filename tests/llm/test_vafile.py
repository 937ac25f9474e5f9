"""Top-k against exact scoring of every pair."""

import numpy as np
from pyspark.sql import functions as F

from donorlens.llm import vafile


def brute(rows, k):
    import math

    vecs = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        vecs.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for n, (q, w) in enumerate(vecs):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(w, c)), i) for m, (i, c) in enumerate(vecs)
                       if m != n and len(c) == len(w))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, extra string")
    got = vafile.top_k(df, F.col("vec_id") % 20 == 0, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [round(float(x), 2) for x in rng.normal(size=5)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # one common vector
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (304, [float("inf")] * 5),
             (None, [1.0] * 5), (320, [1.0, 2.0]), (321, [2.0, 2.0]), (40, [9.0] * 5), (340, [0.0] * 5)]
    want = brute(rows, 20)
    frame = [(i, v, "x") for i, v in rows]
    for bits, block in ((1, 16), (3, 50), (6, 4096)):
        assert run(spark, frame, bits=bits, candidate_block=block, query_block=4) == want


def test_empty_and_single(spark):
    assert run(spark, [(0, [1.0], "x")]) == []
    assert run(spark, [(1, None, "x")]) == []


def test_large_components(spark):
    rows = [(0, [1e6, -1e6], "x"), (1, [1e6, 1e6], "x"), (2, [-1e6, 5e5], "x"), (3, [123456.789, -98765.4321], "x")]
    assert run(spark, rows) == brute([(i, v) for i, v, _ in rows], 20)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for bits in (1, 3, 6):
        v, q = rng.integers(-400, 401, (300, 8)), rng.integers(-400, 401, (20, 8))
        low, width = v.min(0), vafile.cell_width(v.min(0), v.max(0), bits)
        cells = (v - low) // width
        assert cells.min() == 0 and cells.max() < 1 << bits
        middle, slack = vafile.bounds(q, cells.astype(np.uint8), low, width)
        assert (np.abs(2 * (q @ v.T) - middle) <= slack[:, None]).all()


def test_repeated_ids_are_candidates_of_their_own(spark):
    """The better of two rows of one id is found, and a query row meets the other row of its own id."""
    rows = [(1, [0.5, 0.0]), (1, [0.9, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.1, 0.3]), (3, [0.5, 0.0])]
    got = run(spark, [(i, v, "x") for i, v in rows])
    assert got == brute(rows, 20) and (20, 1, 20, 64 * 64) in got and sum(r[2] == 1 for r in got) == 6


def test_exact_vectors_are_read_for_survivors_only():
    """On cells of 6 bits few candidates of a block are left to read."""
    rng = np.random.default_rng(4)
    v = rng.integers(-64, 65, (4096, 16))
    low, width = v.min(0), vafile.cell_width(v.min(0), v.max(0), 6)
    q, c, lower, upper = vafile.scan_block(v[:50], np.arange(50), ((v - low) // width).astype(np.uint8), np.arange(4096),
                                           low, width, 20)
    exact = 2 * (v[:50] @ v.T)
    assert ((lower <= exact[q, c]) & (exact[q, c] <= upper)).all() and (q != c).all()
    assert len(q) < 50 * 4096 * 0.05
    for i in range(50):  # the best twenty are among them
        best = np.lexsort((np.arange(4096), -np.where(np.arange(4096) == i, -10**9, exact[i])))[:20]
        assert set(best) <= set(c[q == i])
