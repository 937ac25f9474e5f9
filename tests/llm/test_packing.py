"""Packing: ids against the whole tokenizer, valid sequences, certified counts."""

import zlib
from itertools import permutations

import numpy as np
from tokenizers import Tokenizer

from donorlens.llm import packing, tokens
from donorlens.llm.common import documents


def check(docs, rows):
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    want = []
    for d in docs.select("doc_id", "text").collect():
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4")
            want.append((d["doc_id"], p, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(held)


def test_documents(spark, sf):
    docs = documents(spark, sf)
    rows = packing.pack_documents(docs).collect()
    used = check(docs, rows)
    assert used <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 1


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, packing.pack_documents(odd_docs).collect())
    assert packing.pack_documents(no_docs).count() == 0


def test_words_of_all_kinds():
    texts = ["don't I'll WE'RE 'S x's", "a b c d\x1ce\x85f", "ΟΔΟΣ ΣΑΣ İstanbul ẞ ǅ", "é é ﬁ ½ Ⅷ 中文字",
             "<|startoftext|>x <|endoftext|>", "\x00 \x7f tab\tnew\r\nline", "1234 5.6e7 #$%&", "", " ", "🙂👍🏽 ok", "ſ K Å"]
    tok, own = Tokenizer.from_file(tokens.default_tokenizer()), tokens.WordTokenizer(tokens.default_tokenizer())
    for t, raw in zip(texts, own.ids([t.encode() for t in texts])):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_cache_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    own = tokens.WordTokenizer(tokens.default_tokenizer())
    first = own.ids([b"alpha beta gamma delta", b"beta epsilon"])
    for _ in range(4):
        assert own.ids([b"zeta eta theta iota kappa"]) == own.ids([b"zeta eta theta iota kappa"])
        assert own.ids([b"alpha beta gamma delta", b"beta epsilon"]) == first


def smallest(lengths, capacity):
    """Fewest bins, by trying every order first-fit."""
    best = len(lengths)
    for order in set(permutations(lengths)):
        bins = []
        for x in order:
            for k, b in enumerate(bins):
                if b + x <= capacity:
                    bins[k] += x
                    break
            else:
                bins.append(x)
        best = min(best, len(bins))
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(150):
        capacity = int(rng.integers(4, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 7))
        opt = smallest(lengths.tolist(), capacity)
        bound = packing.lower_bound(lengths, capacity)
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        assert bound <= opt <= bins.max() + 1
    assert packing.lower_bound(np.array([1025] * 7), 2048) == 7
    assert packing.lower_bound(np.array([700] * 9), 2048) == 5


def test_exchange_keeps_every_piece_and_never_adds_sequences(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(x), int(x)) for i, x in enumerate(rng.integers(300, 1400, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    counts = []
    for rounds in (1, 4):
        got = packing.pack(df, partition_sequences=40, rounds=rounds).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(3000))
        used = {}
        for r in got:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in used.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
        counts.append(len(used))
    assert counts[1] <= counts[0]
