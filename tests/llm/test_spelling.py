"""Spelling variants: words and near words by plain Python, trees forced to be deep, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from donorlens.llm import spelling
from donorlens.llm.common import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def edits(word, letters):
    """All words with one letter inserted, deleted or replaced."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b}
    out |= {a + c + b[1:] for a, b in cut if b for c in letters}
    out |= {a + c + b for a, b in cut for c in letters}
    return out - {word}


def plain_variants(counts, ratio=10):
    letters = sorted(set("".join(counts)))
    near = {w: edits(w, letters) & counts.keys() for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= ratio * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_documents(spark, sf):
    docs = documents(spark, sf)
    want = sorted(plain_variants(plain_counts(docs.collect())), key=repr)
    assert any(r[1] for r in want)
    assert got(spelling.spelling_variants(docs)) == want


def test_deep_trees_blocks_and_anagrams(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    words = Counter()
    for s in stems:
        words[s] = rng.choice([2, 30, 400, 9000])
        for e in rng.sample(sorted(edits(s, "abcé")), 8):
            if len(e) >= 7:
                words[e] += rng.choice([2, 3, 40])
    for _ in range(60):  # words of one and the same vector
        words["".join(rng.sample("aabbcde", 7))] += 2
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    want = sorted(plain_variants(dict(words)), key=repr)
    for cell, block in ((4, 16), (40, 7), (65536, 65536)):
        assert got(spelling.variants(df, cell=cell, block=block)) == want


def test_odd_rows(odd_docs, no_docs, spark):
    assert got(spelling.spelling_variants(odd_docs)) == sorted(plain_variants(plain_counts(odd_docs.collect())), key=repr)
    assert got(spelling.spelling_variants(no_docs)) == []
    long_run = "xyzäÜß" * 5000
    rows = [(1, f"{long_run} {long_run} {long_run}q {long_run}q Straßen straßen STRASSEN÷Straßen")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.spelling_variants(docs)) == sorted(plain_variants_by_pairs(plain_counts(docs.collect())), key=repr)


def plain_variants_by_pairs(counts):
    """As ``plain_variants``, comparing all pairs of words (for few, very long ones)."""
    near = {w: [o for o in counts if spelling.one_edit(w, o)] for w in counts}
    for w in counts:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form = best if best and counts[best] >= 10 * counts[w] else None
        assert form is None or form not in near or not [o for o in near[form] if counts[o] >= 10 * counts[form]]
        yield w, form, form or w, counts[w], len(near[w]), counts[form] if form else None


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=5), st.text("abé", max_size=5))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == (b in edits(a, "abé"))
    if abs(len(b) - len(a)) < 2:
        codes = [np.array([[*map(ord, w), *[0] * (6 - len(w))]]) for w in (a, b)]
        assert spelling.one_edits(*codes, len(b) - len(a)).tolist() == [b in edits(a, "abé")]


def test_misspelling_is_the_stated_one(spark):
    rows = [(i, "Abcdefghij Größenmaß") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = docs.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run")).select(
        spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    n = Counter(r["word"] for r in words.collect())
    want = Counter()
    for i, text in rows:
        for run in text.translate(LOWER).split():
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    assert n == want and len(n) > 5


def test_cell_search_counts_each_pair_once():
    points = pa.table({"word": ["aaaaaaa", "aaaaaab", "aaaaabb"], "n": [5, 9, 2]})
    asks = pa.table({"asked": ["aaaaaaa", "aaaaaab"], "gain": ["", ""], "loss": ["", ""]})
    found = spelling._cell_search(points, asks).to_pylist()
    assert [list(r.values()) for r in found] == [["aaaaaaa", 1, 9, "aaaaaab"], ["aaaaaab", 2, 5, "aaaaaaa"]]
