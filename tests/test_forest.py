"""The forest against plain loops over its trees: bags, pure leaves, votes, out-of-bag, permutation, dependence."""

import hashlib
import math
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from donorlens.operators import forest as RF
from donorlens.plans import modelling as md
from donorlens.session import staged

TREES, SEED = 7, 11
NAMES, NOMINAL = ["a", "b", "c", "d"], [False, False, True, False]


def plain_bag(key, tree, seed=SEED):
    u = int(hashlib.md5(f"{key}|{seed}:bag:{tree}".encode()).hexdigest()[:13], 16) / 2**52
    total, k = 0.0, 0
    while k < 18:
        total += math.exp(-1) / math.factorial(k)
        if u < total:
            break
        k += 1
    return k


def made_rows(n=400):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random(n).round(2), rng.integers(0, 9, n), rng.integers(1, 8, n), rng.normal(0, 1, n)])
    y = ((x[:, 0] + 0.1 * x[:, 3] > 0.6) ^ np.isin(x[:, 2], (2, 5, 6))).astype(int)
    y[::17] ^= 1
    return [(f"d{i}", i, int(y[i]), x[i].tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return made_rows()


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, "donor string, rid long, y int, x array<double>")


@pytest.fixture(scope="module", params=[None, 40])
def forest(request, data):
    """A forest of whole trees in one task each, and one whose upper levels are split by sums."""
    return RF.fit(data, "donor", NAMES, NOMINAL, TREES, SEED, task_rows=request.param)


class Plain:
    """The model's tables as dictionaries, and rows walked down one by one."""

    def __init__(self, forest):
        self.upper = {(r["tree"], r["node"]): r for s in forest.upper for r in s.collect() if r["feature"] >= 0}
        self.nodes = {(r["tree"], r["sub"], r["idx"]): r for r in forest.nodes.collect()}

    @staticmethod
    def left(r, x):
        return x[r["feature"]] in r["cats"] if r["cats"] is not None else x[r["feature"]] <= r["threshold"]

    def leaf(self, tree, x):
        node = 1
        while (tree, node) in self.upper:
            node = 2 * node + (not self.left(self.upper[tree, node], x))
        r = self.nodes[tree, node, 0]
        while r["feature"] >= 0:
            r = self.nodes[tree, node, r["left"] if self.left(r, x) else r["right"]]
        return r

    def vote(self, tree, x):
        r = self.leaf(tree, x)
        return int(r["n1"] > r["n0"])


def test_bags_are_the_stated_draws(spark, data, rows):
    got = {(r["rid"], r["tree"]): r["w"] for r in RF.with_trees(data, "donor", TREES, SEED).collect()}
    assert got == {(i, t): plain_bag(k, t) for k, i, _, _ in rows for t in range(TREES)}
    many = RF.with_trees(spark.range(4000).withColumn("k", F.col("id").cast("string")), "k", 5, 3)
    mean, var = many.agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.05


def test_leaves_are_pure_and_hold_their_bag(forest, rows):
    plain = Plain(forest)
    if forest.upper:
        assert len(forest.upper) >= 3 and any(r["cats"] for r in plain.upper.values())
    held = {}
    for key, _, y, x in rows:
        for t in range(TREES):
            w = plain_bag(key, t)
            if w:
                r = plain.leaf(t, x)
                n = held.setdefault((t, r["sub"], r["idx"]), [0, 0])
                n[y] += w
                assert plain.vote(t, x) == y  # no two rows of this set are alike
    leaves = {k: [r["n0"], r["n1"]] for k, r in plain.nodes.items() if r["feature"] < 0}
    assert leaves == held and all(0 in n for n in held.values())
    for r in [*plain.nodes.values(), *plain.upper.values()]:
        assert r["gain"] >= -1e-9


def test_scores_and_out_of_bag_votes(forest, data, rows, monkeypatch):
    monkeypatch.setattr(RF, "BLOCK_ROWS", 37)
    plain = Plain(forest)
    got = {r["rid"]: (r["votes"], r["trees"]) for r in RF.scores(forest, data).collect()}
    assert got == {i: (sum(plain.vote(t, x) for t in range(TREES)), TREES) for _, i, _, x in rows}
    got = {r["rid"]: (r["votes"], r["trees"]) for r in RF.out_of_bag(forest, data, "donor").collect()}
    for key, i, _, x in rows:
        out = [t for t in range(TREES) if not plain_bag(key, t)]
        assert got[i] == (sum(plain.vote(t, x) for t in out), len(out))


def test_partial_dependence_equals_copies_of_every_row(forest, data, rows, monkeypatch):
    monkeypatch.setattr(RF, "BLOCK_ROWS", 150)
    plain = Plain(forest)
    for var, grid in (("a", np.linspace(0, 1, 51).tolist()), ("b", [float(v) for v in range(9)]), ("d", [0.25])):
        k = NAMES.index(var)
        got = {r["value"]: r["yhat"] for r in RF.partial_dependence(forest, data, var, grid).collect()}
        assert sorted(got) == grid
        for g in grid:
            votes = [plain.vote(t, [*x[:k], g, *x[k + 1:]]) for *_, x in rows for t in range(TREES)]
            assert got[g] == pytest.approx(sum(votes) / len(votes), abs=1e-9)


def test_permutation_importance_over_out_of_bag_rows(forest, data, rows):
    plain, per_bucket = Plain(forest), 40
    buckets = math.ceil(len(rows) * 0.4 / per_bucket)
    got = {r["variable"]: r for r in RF.permutation_importance(forest, data, "donor", per_bucket).collect()}
    hashes = {(r["rid"], r["t"]): r["h"] for r in data.select("rid", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias(
        "t")).select("rid", "t", F.xxhash64("rid", "t", F.lit(SEED)).alias("h")).collect()}
    y = {i: c for _, i, c, _ in rows}
    right = {}
    for t in range(TREES):
        for b in range(buckets):
            own = [(hashes[i, t], i, x) for key, i, _, x in rows if not plain_bag(key, t) and hashes[i, t] % buckets == b]
            if not own:
                continue
            part = pa.table({"h": [h for h, _, _ in own], "rid": [i for _, i, _ in own], "x": [x for *_, x in own],
                             "tree": [t] * len(own), "bucket": [b] * len(own)})
            made = RF._shifted(len(NAMES), SEED)(part).to_pylist()
            for v in range(len(NAMES)):  # permuted, nothing else
                before = sorted(x[v] for *_, x in own)
                assert sorted(m["x"][v] for m in made if m["variant"] == v) == before
            for m in made:
                right.setdefault((t, m["variant"]), []).append(plain.vote(t, m["x"]) == y[m["rid"]])
    acc = {k: sum(v) / len(v) for k, v in right.items()}
    for v, name in enumerate(NAMES):
        drops = [acc[t, -1] - acc[t, v] for t in range(TREES)]
        assert got[name]["mean_decrease_accuracy"] == pytest.approx(statistics.mean(drops), abs=1e-12)
        assert got[name]["sd"] == pytest.approx(statistics.stdev(drops), abs=1e-12)
    assert max(got, key=lambda n: got[n]["mean_decrease_accuracy"]) in ("a", "c")


def test_gini_importance_sums_the_gains(forest):
    plain = Plain(forest)
    want = dict.fromkeys(NAMES, 0.0)
    for r in [*plain.nodes.values(), *plain.upper.values()]:
        if r["feature"] >= 0:
            want[NAMES[r["feature"]]] += r["gain"] / TREES
    assert {r["variable"]: r["mean_decrease_gini"] for r in RF.gini_importance(forest).collect()} == pytest.approx(want)


def test_unsplittable_pure_and_empty_inputs(spark, data):
    same = spark.createDataFrame([(f"k{i}", i, int(i % 3 == 0), [1.0, 2.0]) for i in range(300)],
                                 "donor string, rid long, y int, x array<double>")
    for limit in (None, 20):  # equal rows of both classes: one leaf, whatever its size
        f = RF.fit(same, "donor", ["u", "v"], [False, False], 3, 1, task_rows=limit)
        assert f.nodes.count() == 3 and RF.scores(f, same).agg(F.sum("votes")).first()[0] == 0
    pure = RF.fit(data.withColumn("y", F.lit(1)), "donor", NAMES, NOMINAL, 3, 1, task_rows=20)
    assert pure.nodes.count() == 3 and RF.scores(pure, data).filter("votes < 3").count() == 0
    none = RF.fit(data.filter("false"), "donor", NAMES, NOMINAL, 3, 1)
    assert none.nodes.count() == 0 and RF.scores(none, data).count() == 0
    assert RF.out_of_bag(none, data.filter("false"), "donor").count() == 0


def test_depth_limit(data):
    for limit in (None, 60):
        f = RF.fit(data, "donor", NAMES, NOMINAL, 2, 5, max_depth=2, task_rows=limit)
        splits = f.nodes.filter("feature >= 0").count() + sum(s.filter("feature >= 0").count() for s in f.upper)
        assert 2 <= splits <= 2 * 3


def test_model_keeps_rows_with_unknown_levels(spark):
    rows = [(f"d{i}", float(i % 50), ["x", "y", None][i % 3], int(i % 50 > 24)) for i in range(300)]
    df = spark.createDataFrame(rows, "donor string, v double, pay_type string, status int")
    m = md.fit_forest(df, ["v", "pay_type"], n_trees=9)
    oob = md.out_of_bag_votes(m).collect()
    assert len(oob) == 200 and all(r["oob_trees"] + sum(plain_bag(r["donor"], t, md.SEED) > 0 for t in range(9)) == 9 for r in oob)
    err = md.error_rates(md.out_of_bag_votes(m), "oob").first()
    assert err["oob_error"] < 0.1 and err["n"] == 200
    got = md.forest_scores(m, df.unionByName(spark.createDataFrame([("n", 1.0, "new", 1)], df.schema)), "t").collect()
    assert len(got) == 301 and sum(r["probability"] is None for r in got) == 101
    bags = {r["tree"]: r for r in md.bags(df, ["v", "pay_type"], 9).collect()}
    assert all(r["bag_rows"] + r["oob_rows"] == 200 for r in bags.values())
    assert md.partial_dependence(m, df.withColumn("v", F.lit(None).cast("double")), "v").count() == 0


def test_a_bag_is_drawn_from_one_hash_per_row_and_tree(spark, data):
    """The steps of the draw, and a filter on it, do not repeat the hash: that made a draw 20 times as dear."""
    plan = RF.with_trees(data, "donor", TREES, SEED).filter("w > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("md5(") <= 3


def test_lists_of_few_rows_split_like_arrays(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (5, 40, 300):
        x = np.column_stack([rng.integers(0, 6, n), rng.random(n).round(1), rng.integers(1, 5, n)]).astype(float)
        y, w = rng.integers(0, 2, n), rng.integers(1, 4, n)
        got = []
        for few in (0, 32):
            monkeypatch.setattr(RF, "FEW", few)
            got.append(RF.grow(x, y, w, [False, False, True], 2, [n]))
        assert got[0] == got[1] and len(got[0]["feature"]) > 1


@pytest.mark.parametrize("grid, wide", [(1, 4096), (128, 3)])
def test_large_nodes_that_the_grid_cannot_split(data, rows, monkeypatch, grid, wide):
    """A grid of one bin, or a factor too wide for it: quantiles of the nodes' own rows split them."""
    monkeypatch.setattr(RF, "GRID", grid)
    monkeypatch.setattr(RF, "MAX_LEVELS", wide)
    f = RF.fit(data, "donor", NAMES, NOMINAL, 2, SEED, task_rows=120)
    plain = Plain(f)
    assert plain.upper and all(plain.vote(t, x) == y for key, _, y, x in rows for t in range(2) if plain_bag(key, t))


def test_bags_of_a_fit_are_the_stated_draws(spark, forest, data, rows):
    keys = spark.createDataFrame([(k,) for k, *_ in rows] + [("é x",), ("",), (None,)], "k string")
    both = keys.select(RF.poisson_bags(F.col("k"), 30, SEED).alias("a"), RF.drawn_bags(F.col("k"), 30, SEED).alias("b"))
    assert both.filter("a <=> b").count() == len(rows) + 3
    # a fit keeps them: out-of-bag votes and importances draw no second time
    for own, again in ((RF.out_of_bag(forest), RF.out_of_bag(forest, data, "donor")),
                       (RF.permutation_importance(forest), RF.permutation_importance(forest, data, "donor"))):
        assert sorted(map(str, own.collect())) == sorted(map(str, again.collect()))


def plain_grow(x, y, w, nominal, mtry, seed):
    """A tree by sorting each node's rows and trying every cut, without ranks."""
    rng, out = np.random.default_rng(seed), []

    def node(rows):
        at, own = len(out), [(x[i], y[i], w[i]) for i in rows]
        n = [sum(k for _, c, k in own if c == side) for side in (0, 1)]
        out.append(None)
        best, tried = None, 0
        for f in rng.permutation(x.shape[1]).tolist() if all(n) else ():
            sums = {}
            for v, c, k in own:
                sums.setdefault(math.inf if math.isnan(v[f]) else v[f], [0, 0])[c] += k
            steps = sorted(sums, key=lambda v: (sums[v][1] / sum(sums[v]), v) if nominal[f] else v)
            cuts = []
            for j in range(1, len(steps)):
                if steps[j] == math.inf:
                    continue
                left = [sum(sums[v][c] for v in steps[:j]) for c in (0, 1)]
                right = [n[c] - left[c] for c in (0, 1)]
                cuts.append((sum(a * a for a in left) / sum(left) + sum(a * a for a in right) / sum(right), -j))
            if cuts:
                tried += 1
                q, j = max(cuts)
                if best is None or q > best[0]:
                    best = q, f, steps[:-j], steps[-j]
                if tried == mtry:
                    break
        if best is None:
            out[at] = (-1, None, None, -1, -1, *n)
            return at
        _, f, low, high = best
        cut = None if nominal[f] else low[-1] + (high - low[-1]) / 2
        go = [x[i][f] in low if nominal[f] else x[i][f] <= cut for i in rows]
        left = node([i for i, g in zip(rows, go) if g])
        right = node([i for i, g in zip(rows, go) if not g])
        out[at] = (f, cut, sorted(map(int, low)) if nominal[f] else None, left, right, *n)
        return at

    node(list(range(len(y))))
    return out


@pytest.mark.parametrize("missing", [False, True])
def test_trees_from_packed_ranks_equal_plain_ones(missing):
    rng = np.random.default_rng(5)
    for n in (1, 7, 90, 500):
        x = np.column_stack([rng.integers(0, 6, n), rng.normal(0, 1, n), rng.integers(1, 5, n)]).astype(float)
        if missing:
            x[::5, 1] = np.nan
        y, w = rng.integers(0, 2, n).astype(np.int8), rng.integers(1, 8, n).astype(np.int8)
        got = RF.grow(x, y, w, [False, False, True], 2, [n])
        columns = ("feature", "threshold", "cats", "left", "right", "n0", "n1")
        assert list(zip(*[got[c] for c in columns])) == plain_grow(x, y.tolist(), w.tolist(), [False, False, True], 2, [n])


def test_packed_ranks_tell_the_values_apart():
    x = np.array([[0.5, 3], [np.nan, 1], [-1, 3], [0.5, 2]])
    keys, values, tops, shift = RF._packed_columns(x, np.array([1, 0, 1, 0], np.int8), np.array([1, 5, 2, 1], np.int8))
    assert [(k >> shift).tolist() for k in keys] == [[1, 2, 0, 1], [2, 0, 2, 1]] and tops == [2, 3]
    assert [v[:t].tolist() for v, t in zip(values, tops)] == [[-1, 0.5], [1, 2, 3]]


def test_large_nodes_are_split_by_one_task_as_by_levels(forest, data, rows, monkeypatch):
    """A task that holds a tree's bins splits all its large nodes; where they are too many, levels of sums give the same."""
    if not forest.upper:
        return
    calls = []
    by_level = RF._grid_splits
    monkeypatch.setattr(RF, "_grid_splits", lambda *a: calls.append(a[1]) or by_level(*a))
    monkeypatch.setattr(RF, "CODED_BYTES", 150 * 5)  # nodes of more than 150 rows by sums, those below by one task
    some = RF.fit(data, "donor", NAMES, NOMINAL, TREES, SEED, task_rows=40)
    monkeypatch.setattr(RF, "CODED_BYTES", 0)
    none = RF.fit(data, "donor", NAMES, NOMINAL, TREES, SEED, task_rows=40)
    assert len(calls) > 3
    calls.clear()
    monkeypatch.setattr(RF, "CODED_BYTES", 150 * 500)
    RF.fit(data, "donor", NAMES, NOMINAL, TREES, SEED, task_rows=40)
    assert not calls  # no pass over the rows for each level
    plain = [Plain(f) for f in (forest, some, none)]
    assert plain[0].upper == plain[1].upper == plain[2].upper and plain[0].nodes == plain[1].nodes == plain[2].nodes
    x = np.array([r[3] for r in rows])
    for tree in range(TREES):  # rows go down as one by one
        node = np.ones(len(x), np.int64)
        for _, i, _, _, left in forest.above.steps(tree, x, node, np.arange(len(x))):
            node[i] = 2 * node[i] + ~left
        assert forest.above.down(tree, x).tolist() == node.tolist()


def test_hashes_of_many_keys_at_once_are_md5():
    """Bags hash whole batches; keys that fill a block and longer ones too."""
    keys = [b"", "é x".encode(), b"Const-12#7", *(b"k" * n for n in range(40, 70)), b"q" * 300]
    ends = [f"|{SEED}:bag:{t}".encode() for t in (0, 7, 10, 99, 100)]
    want = [[int(hashlib.md5(k + e).hexdigest()[:16], 16) for e in ends] for k in keys]
    assert RF._hash_heads(keys, ends).tolist() == want and RF._hash_heads([], ends).shape == (0, 5)


def test_rows_meet_whole_trees_as_they_meet_subtrees(spark, forest, data, rows, monkeypatch):
    """Votes, permuted and dependent, of whole trees and of trees taken subtree by subtree; permuted rows are written nowhere."""
    def results():
        return [sorted(map(str, d.collect())) for d in (
            RF.scores(forest, data), RF.out_of_bag(forest), RF.partial_dependence(forest, data, "a", [0.1, 0.4, 0.8]))] + [
            {r["variable"]: r.asDict() for r in RF.permutation_importance(forest, data, "donor", 30).collect()}]

    written = []
    monkeypatch.setattr(RF, "staged", lambda df, name: written.append(name) or staged(df, name))
    monkeypatch.setattr(RF, "WHOLE_ROWS", 90)
    monkeypatch.setattr(RF, "WHOLE_TREES", 3)
    monkeypatch.setattr(RF, "WHOLE_BUCKETS", 2)
    *whole, permuted = results()
    assert "variants" not in written
    monkeypatch.setattr(RF, "WHOLE_NODES", 0)
    *routed, apart = results()
    assert whole == routed and permuted.keys() == apart.keys() and "variants" in written
    for name, row in permuted.items():
        assert {k: v for k, v in row.items() if k != "variable"} == pytest.approx({k: v for k, v in apart[name].items() if k != "variable"}, abs=1e-12)


def test_row_hashes_are_those_of_sql(spark):
    ids = [0, 1, -5, 7 << 40, 2**63 - 1, -2**63]
    df = spark.createDataFrame([(i, t) for i in ids for t in (0, 3, 99)], "rid long, t int")
    for r in df.select("rid", "t", F.xxhash64("rid", "t", F.lit(SEED)).alias("h")).collect():
        assert RF._row_hashes(np.array([r["rid"]]), r["t"], SEED).tolist() == [r["h"]]
