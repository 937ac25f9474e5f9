"""SimHash groups against brute force over all pairs of fingerprints."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from donorlens.llm import components, simhash
from donorlens.llm.common import documents


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
             .split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def check(docs, **kw):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(
        rows, fps, plain_groups([r["doc_id"] for r in rows], fps))), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, **kw).collect()), key=repr)
    assert got == want


def test_groups_equal_brute_force_on_documents(spark, sf):
    check(documents(spark, sf))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert simhash.keep_one(no_docs).count() == 0
    named = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(named) == len(set(named)) and 1 in named and 2 not in named


@pytest.mark.parametrize("blocks,tree_rows", [(4, 7), (5, 16384), (6, 3)])
def test_links_of_a_dense_cluster(spark, blocks, tree_rows):
    """A cluster that shares its blocks, in small trees: no link is lost."""
    rng = np.random.default_rng(5)
    fps = {int(rng.integers(0, 1 << 62))}
    while len(fps) < 150:
        near = list(fps)[rng.integers(len(fps))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            near ^= 1 << int(b)
        fps.add(near)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    comp = components.connected_components(simhash.fingerprint_links(df, 3, blocks, tree_rows))
    root = {r["vertex"]: r["root"] for r in comp.collect()}
    got = {}
    for i, f in enumerate(signed):
        got.setdefault(root.get(f, f), set()).add(i)
    want = {}
    for i, c in enumerate(plain_groups(list(range(len(fps))), fps)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bk_tree_children_hang_under_their_distance():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    forest = simhash.Forest(np.zeros(len(fps), np.int64), fps, 1)
    parent, distance = np.nonzero(forest.child >= 0)
    child = forest.child[parent, distance]
    assert len(child) == len(fps) - 1 and len(set(child.tolist())) == len(child)
    assert (np.bitwise_count(fps[parent] ^ fps[child]) == distance).all()


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.connected_components(chain).collect()
    assert len(got) == 200 and {r["root"] for r in got} == {0}


def test_one_row_of_each_group_whatever_its_id(spark):
    """Equal ids on different texts are different rows; copies without id go; of equal rows one stays."""
    text = "the quick brown fox jumps over the lazy dog near the river bank today " * 3
    lone = "lonely text without any id at all here"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (1, "wholly different words here indeed and more of them", "c"),
            (None, text, "z"), (None, lone, "q"), (None, lone, "q"), (3, None, "f"), (4, " ", "g"), (None, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(1, text, "a"), rows[3], (None, lone, "q"), (3, None, "f")]
    for n in (1, 7):
        assert sorted(map(repr, map(tuple, simhash.keep_one(df.repartition(n)).collect()))) == sorted(map(repr, want))
