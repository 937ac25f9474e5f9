"""Mixing: targets against a plain redistribution, exact quotas, and odd rows."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from donorlens.llm import mixing, queries
from donorlens.llm.common import documents


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(sizes, 0.0), set(order), float(sum(sizes.values()))
    while open_ and rest > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += rest * w[s] / total
        rest = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows):
    largest = defaultdict(int)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3 and len(r["shards"]) == r["copies"]
        assert all(0 <= s < mixing.SHARDS for s in r["shards"])
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
    for s in sizes:
        assert abs(want[s] - taken[s]) <= largest[s] / 2, (s, want[s], taken[s])


def test_documents(spark, sf):
    docs = documents(spark, sf)
    mix = mixing.mixture(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "shards")
    rows = mix.collect()
    assert len(rows) == docs.count()
    check(rows)
    again = sorted(map(tuple, queries.op10_mixing_tree(spark, sf).collect()))
    assert again == sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * r["copies"],
                            r["copies"], r["shards"]) for r in rows)  # reruns agree


def test_hot_source_and_caps(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), "hot" if i % 3 else f"s{i % 12}") for i in range(900)]
    rows += [(1000, "one two", "rare"), (1001, "one two three", None), (1002, None, "empty"), (1003, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mixture(df).select("row.source", "size", "source_size", "target", "copies", "shards").collect()
    check(mix)
    assert all(r["copies"] == 0 for r in mix if r["source"] == "empty")


def test_splitting_tree_is_exact():
    quotas = np.array([1000, 0, 7, 123456, 1])
    runs = mixing.splitting_tree(quotas, 16)
    assert (runs.sum(1) == quotas).all() and (runs >= 0).all()
    assert runs.sum(0).max() - runs.sum(0).min() <= 16
    assert (mixing.splitting_tree(quotas, 16) == runs).all()


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mixture(odd_docs).select("row.source", "size", "source_size", "target", "copies", "shards").collect()
    assert len(rows) == odd_docs.count()
    check(rows)
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixture(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_very_long_documents_do_not_end_the_cut(spark):
    """Sources of one very long document among short ones, of which 60% or 40% are wanted (once more)."""
    rows = [(1000 * s + i, "w " * (20_000 if i == 0 else 60), f"s{s}") for s in range(12) for i in range(1001)]
    rows += [(1000 * s + i, "w " * (30_000 if i == 0 else 60), f"s{s}") for s in range(20, 24) for i in range(501)]
    rows += 2 * [(1, "w " * 50, "t0"), (2, "w " * 200, "t0")] + [(i, "w " * 3, "t0") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mixture(df, weights=(0.6, 1.4)).select("row.source", "row.doc_id", "size", "target", "copies", "shards")
    taken, target, alike = defaultdict(int), {}, defaultdict(set)
    for r in mix.collect():
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        alike[r["source"], r["doc_id"], r["size"]].add(r["copies"])
        assert all(0 <= s < mixing.SHARDS for s in r["shards"])
    for s in target:
        assert abs(target[s] - taken[s]) <= 30, (s, target[s], taken[s])
    assert all(max(c) - min(c) <= 1 for c in alike.values())  # equal rows differ by at most one


def test_equal_rows_have_places_of_their_own(spark):
    """A source of 900 equal rows without id misses its target by less than one of them."""
    rows = [(None, "w " * 10, "a")] * 900 + [(i, "w " * 10, "a") for i in range(100)]
    rows += [(i, "w " * 10, "b") for i in range(1000)] + [(7, "w " * 3, None)] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mixture(df).select("row.source", "row.doc_id", "size", "target", "copies", "shards", "h").collect()
    taken, target, shards = defaultdict(int), {}, defaultdict(int)
    for r in mix:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        for s in r["shards"]:
            shards[s] += r["size"]
    assert all(abs(target[s] - taken[s]) < 10 for s in target), (target, taken)
    assert len({r["h"] for r in mix}) == len(mix)
    assert max(shards.values()) < 1.3 * min(shards.values())  # equal rows are dealt to all shards
    again = mixing.mixture(df.repartition(3)).select("row.source", "row.doc_id", "size", "target", "copies", "shards", "h")
    assert sorted(map(repr, mix)) == sorted(map(repr, again.collect()))


def test_many_equal_rows_are_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    df = spark.createDataFrame([(1, "a b", "s")] * 100 + [(2, "a b", "s")] * 50 + [(3, "c d", "t")] * 10,
                               "doc_id long, text string, source string")
    check(mixing.mixture(df).select("row.source", "size", "source_size", "target", "copies", "shards").collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=9), st.floats(0, 300))
def test_nearest_sum_equals_all_choices(sizes, left):
    got = mixing.nearest_sum(left, sizes)
    best = min(abs(sum(c) - round(left)) for k in range(len(sizes) + 1) for c in combinations(sizes, k))
    assert len(set(got)) == len(got) and abs(sum(sizes[i] for i in got) - round(left)) == best


def test_jobs_do_not_grow_with_the_input(spark, sf):
    """The number of Spark jobs, stages that adaptive execution runs as jobs included."""
    jobs = []
    for docs in (documents(spark, sf), documents(spark, sf).limit(20)):
        scheduler = spark.sparkContext._jsc.sc().dagScheduler()
        before = scheduler.nextJobId()
        mixing.mixture(docs).write.format("noop").mode("overwrite").save()
        jobs.append(scheduler.nextJobId() - before)
    assert max(jobs) <= 30, jobs
