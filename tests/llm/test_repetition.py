"""Suffix-array repetition against direct comparison of all suffixes."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from donorlens.llm import repetition


def brute_repeat(w):
    n, out = len(w), [0] * len(w)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=5))
def test_longest_repeats(texts):
    ids = np.array([x for t in texts for x in t], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert repetition.longest_repeats(ids, text).tolist() == [x for t in texts for x in brute_repeat(t)]


def brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    rep = brute_repeat(w)

    def covered(least, cut=None):
        return len({i for p, r in enumerate(rep) if r >= least for i in range(p, p + (cut or r))})

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_repeat, n_cov = covered(3, 3), covered(repetition.MIN_REPEAT)
    failed = len(w) < 50 or 100 * n_repeat > 50 * len(w)
    kept = not failed and n_cov <= repetition.MAX_COVERED * len(w) and max(rep, default=0) <= repetition.MAX_REPEAT
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n_repeat,
            n_cov, max(rep, default=0), failed, kept)


def test_all_columns(spark):
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(130))
    texts = [None, "", " \n ", "a\n\na\nb #x <y>  z\x1c é　ü", "for " * 300, passage,
             passage + " x " + " ".join(f"u{i}" for i in range(400)) + " " + passage]
    texts += [" ".join(rng.choice(["aa", "b", "çc", "d,", "e\n", "f"], rng.integers(0, 200))) for _ in range(20)]
    texts += ["\n".join(rng.choice(["one two", " ", "one", "two # three"], 60)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in repetition.quality(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)


def test_odd_rows(odd_docs, no_docs):
    rows = repetition.quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] == 0)
    assert repetition.quality(no_docs).count() == 0
