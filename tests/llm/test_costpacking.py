"""Cost-balanced packing: ids against the whole tokenizer, full sequences, the choice by a plain scan."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from donorlens.llm import costpacking, tokens
from donorlens.llm.common import documents


def check(docs, rows):
    """Every id lies in one piece, sequences are gapless and full; gives the lengths of the sequences."""
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    texts = defaultdict(list)
    for d in docs.select("doc_id", "text").collect():
        ids = np.array(tok.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        texts[d["doc_id"], len(ids)].append(ids)
        want[d["doc_id"], len(ids)] += len(ids)
    got, held = Counter(), defaultdict(list)
    starts = defaultdict(Counter)
    for r in rows:
        key = r["doc_id"], r["doc_tokens"]
        end = r["start"] + r["length"]
        assert any(zlib.crc32(t[r["start"]:end].tobytes()) == r["ids_crc32"] for t in texts[key]) and r["length"] > 0
        got[key] += r["length"]
        for i in range(r["start"], end):
            starts[key][i] += 1
        held[r["sequence_id"]].append(r)
    assert got == want
    assert all(set(c.values()) == {len(texts[k])} for k, c in starts.items())
    for parts in held.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["sequence_tokens"] <= 2048 and at & (at - 1) == 0
        price = sum(costpacking.cost(r["length"]) for r in parts)
        assert all(abs(r["sequence_cost"] - price) < 1e-6 * price for r in parts)
    return [parts[0]["sequence_tokens"] for parts in held.values()]


def test_documents(spark, sf):
    docs = documents(spark, sf)
    rows = costpacking.pack_documents(docs).collect()
    lengths = check(docs, rows)
    assert sum(n < 2048 for n in lengths) <= 11
    # small partitions, several rounds: still at most one short sequence of each power of two
    rows = costpacking.pack_documents(docs, partition_sequences=4, partition_rows=8).collect()
    assert sum(n < 2048 for n in check(docs, rows)) <= 11


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, costpacking.pack_documents(odd_docs).collect())
    assert costpacking.pack_documents(no_docs).count() == 0


def test_many_empty_texts(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    rows = costpacking.pack_documents(docs, partition_rows=300).collect()
    assert sorted(check(docs, rows)) == [8, 128, 256, 512, 2048, 2048]


def scan(lengths, capacities):
    """The first phase with a scan of all sequences: (item, sequence) of what fits whole."""
    room, price, out = list(capacities), [0.0] * len(capacities), []
    for i, n in enumerate(lengths):
        fits = [(price[b], room[b], b) for b in range(len(room)) if room[b] >= n]
        if fits:
            b = min(fits)[2]
            room[b] -= n
            price[b] += costpacking.cost(n)
            out.append((i, b))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_choice_equals_a_scan(items):
    lengths = np.array(sorted(items, reverse=True), np.int64)
    total = int(lengths.sum())
    capacities = [64] * (total // 64) + [1 << k for k in reversed(range(6)) if total % 64 >> k & 1]
    placed = costpacking.fill(lengths, capacities)
    assert [(i, b) for i, at, n, b, _ in placed if not at and n == lengths[i]][:len(scan(lengths, capacities))] == scan(
        lengths, capacities)
    used = np.zeros((len(capacities), 64), int)
    for i, at, n, b, offset in placed:
        used[b, offset:offset + n] += 1
    assert all(used[b, :c].min(initial=1) == 1 and used[b].sum() == c for b, c in enumerate(capacities))


def test_costs_are_balanced():
    """Costs of full sequences differ far less than in the order of arrival."""
    rng = np.random.default_rng(7)
    lengths = np.minimum(np.exp(rng.normal(5, 1, 20_000)).astype(np.int64) + 1, 2047)
    capacities = [2048] * (int(lengths.sum()) // 2048)

    def spread(assigned, n):
        p = np.bincount(assigned, costpacking.cost(n), minlength=len(capacities))
        return p.std() / p.mean()

    placed = np.array(costpacking.fill(np.sort(lengths)[::-1], capacities))
    placed = placed[placed[:, 3] >= 0]
    arrival = np.minimum((np.cumsum(lengths) - 1) // 2048, len(capacities) - 1)
    assert spread(placed[:, 3], placed[:, 2]) < 0.6 * spread(arrival, lengths)
    assert len(placed) < 1.1 * len(lengths)  # few pieces are cut
