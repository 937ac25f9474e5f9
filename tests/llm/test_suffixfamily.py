"""Removal of repeated 400-byte strings against counting all of them."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from donorlens.llm import suffixfamily
from donorlens.llm.common import documents


def brute(texts, length=400):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, **kw):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows]))), key=repr)
    got = suffixfamily.remove_repeats(docs, **kw)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for r in got.collect():  # the bytes that remain are the ones counted and hashed
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    got = got.drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def made_texts():
    rng = np.random.default_rng(3)

    def noise(n):
        return "".join(chr(c) for c in rng.integers(97, 123, n))

    base = [noise(int(rng.integers(300, 3000))) for _ in range(10)]
    texts = []
    for _ in range(40):
        t = ""
        for _ in range(rng.integers(1, 5)):
            b = base[rng.integers(10)]
            i = int(rng.integers(0, len(b)))
            t += b[i:i + int(rng.integers(0, 1500))] + noise(int(rng.integers(0, 40)))
        texts.append(t)
    passage = noise(900)
    texts += [noise(50) + passage + noise(300) for _ in range(12)]  # one passage, always another continuation
    return texts + ["", None, "a" * 399, "a" * 400, "b" * 401, "c" * 1000, "xy" * 900, base[0], base[0], "for " * 500,
                    "é" * 700, "ü" + "é" * 700]


@pytest.mark.parametrize("batches,hot", [(1, 20_000), (4, 20_000), (5, 1)])
def test_made_texts(spark, batches, hot):
    check(spark.createDataFrame(list(enumerate(made_texts())), "doc_id long, text string"), batches=batches, hot=hot)


def test_documents(spark, sf):
    check(documents(spark, sf))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert suffixfamily.remove_repeats(no_docs).count() == 0


def test_no_stage_runs_two_python_functions(spark):
    """Each keeps workers of its own in every executor: text and spans meet one function, however small the other side is."""
    docs = spark.createDataFrame(list(enumerate(made_texts())), "doc_id long, text string")
    plan = suffixfamily.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    # the strings of hot contexts, read by both sides of a join far below; and the cut
    assert plan.count("ArrowEvalPython") == 3, plan


def test_hashes_of_windows_are_made_without_an_object_each(spark):
    rows = [(bytes(range(256)) * 3, 320, 3), (b"x" * 400, 0, 0)]
    df = spark.createDataFrame(rows, "context binary, before int, least int")
    got = df.select("before", suffixfamily._window_hashes().alias("w")).collect()
    assert [[w["o"] for w in r["w"]] for r in got] == [list(range(3, 321)), [0]]
    assert len({(w["h1"], w["h2"]) for w in got[0]["w"]}) == 256  # the context repeats after 256 bytes


def test_levels_merge_geometrically(spark):
    rows = [(k, k, 1, 5, 0, b"x" * 405) for k in range(7)]
    family = suffixfamily.Family(4)
    df = spark.createDataFrame(rows, "key long, cid long, n long, before int, least int, context binary")
    sizes = []
    for k in range(7):
        family.add(df.filter(df.key == k))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    assert sum(level.count() for _, level in family.levels) == 7


def test_every_start_has_one_anchor_that_depends_on_its_string_only():
    rng = np.random.default_rng(0)
    part = bytes(rng.integers(97, 100, 900, dtype=np.uint8))
    a = bytes(rng.integers(97, 123, 333, dtype=np.uint8)) + part
    b = bytes(rng.integers(97, 123, 77, dtype=np.uint8)) + part + b"tail"

    def chosen(t):
        at, lo, hi = suffixfamily.anchors(t)
        assert (hi[:-1] + 1 == lo[1:]).all() and lo[0] == 0 and hi[-1] == len(t) - 400
        assert (at >= lo).all() and (at + suffixfamily.CHUNK <= hi + 400).all() and (at - lo < suffixfamily.WINDOW).all()
        return np.repeat(at, hi - lo + 1)

    ca, cb = chosen(a), chosen(b)
    for s in range(900 - 400 + 1):
        assert ca[333 + s] - (333 + s) == cb[77 + s] - (77 + s)
