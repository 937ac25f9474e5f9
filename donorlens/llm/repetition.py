"""Quality rules on repetition inside a text, from suffix arrays.

The texts of an Arrow batch are cut into words, and one suffix array over all
their words is built by prefix doubling: suffixes are first sorted by (text,
word), and every round doubles the compared length for the suffixes that are
still tied. Texts never share a rank, so no match crosses from one to another.
Neighbours' longest common prefixes come from the ranks of the rounds.

The deepest longest-common-prefix interval around a suffix has the value
``max(lcp before, lcp after)``: the longest substring that starts there and is
found again in the same text. The spans of those substrings, where they are at
least ``MIN_REPEAT`` words long, cover exactly the occurrences of all maximal
repeats; their union gives the covered fraction. A text is rejected if that
fraction or the longest repeat is over its limit. With three words as the least
length the same spans give the words in repeated 3-word windows.

Scoring is a map over whole texts; a batch is worked through in slices of
bounded size, one text at least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.tokens import batches

MIN_REPEAT = 10
MAX_COVERED = 0.4
MAX_REPEAT = 100
MIN_WORDS = 50
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = _SPACES + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes


def longest_repeats(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word position, the length of the longest word sequence that starts
    there and also starts elsewhere in the same text. ``text`` is sorted."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, text))
    key = text[order].astype(np.int64) * (int(ids.max()) + 1) + ids[order]

    def groups(keys: np.ndarray) -> np.ndarray:
        """First index of each sorted key's group."""
        new = np.r_[True, keys[1:] != keys[:-1]]
        return np.flatnonzero(new)[np.cumsum(new) - 1]

    rank = np.empty(n + 1, np.int64)
    rank[order] = groups(key)
    rank[n] = -1
    levels = [rank.astype(np.int32)]
    alone = np.bincount(rank[:n], minlength=n) == 1
    tied = order[~alone[rank[order]]]
    step = 1
    while len(tied):
        after = np.minimum(tied + step, n)
        # beyond the end of a text stands another text's rank, which no tied partner shares
        key = rank[tied] * (n + 1) + rank[after] + 1
        o = np.argsort(key, kind="stable")
        tied, key = tied[o], key[o]
        old = groups(rank[tied])
        new = groups(key)
        rank[tied] += new - old
        levels.append(rank.astype(np.int32))
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
        tied = tied[np.repeat(size, size) > 1]
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank[:n]] = np.arange(n)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    pair = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pair], b[pair]
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a < n) & (b < n)
        hit = np.flatnonzero(same)
        lcp[pair[hit]] += 1 << k
        a[hit] = np.minimum(a[hit] + (1 << k), n)
        b[hit] = np.minimum(b[hit] + (1 << k), n)
    own = np.zeros(n, np.int64)
    if n > 1:
        own[suffix[:-1]] = lcp
        own[suffix[1:]] = np.maximum(own[suffix[1:]], lcp)
    return own


def _covered(repeat: np.ndarray, least: int, cut: int | None = None) -> np.ndarray:
    """Which positions lie in ``[p, p + repeat)`` of a position p with ``repeat >= least``."""
    at = np.flatnonzero(repeat >= least)
    length = repeat[at] if cut is None else np.full(len(at), cut)
    edge = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of each text: words, characters, symbols, repeated lines and words."""
    texts = [t or b"" for t in texts]
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    text = np.repeat(np.arange(len(texts)), n_words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, len(text))
    repeat = longest_repeats(ids, text)
    size = len(texts)
    longest = np.zeros(size, np.int64)
    np.maximum.at(longest, text, repeat)
    dup_lines = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(_SPACES)] if b"\n" in t else ()
        dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t.translate(None, _NOT_COUNTED)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": np.bincount(text[_covered(repeat, 3, 3)], minlength=size).astype(np.int64),
        "n_covered_words": np.bincount(text[_covered(repeat, MIN_REPEAT)], minlength=size).astype(np.int64),
        "longest_repeat": longest,
    }


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def counts_column(text_col):
    """Struct of the counts of a text column."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        parts = [measure(part) for part in batches(texts.cast(pa.large_binary()).to_pylist(), 4_000_000)]
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)) for c in _COUNTS],
            names=_COUNTS)

    return counts(text_col)


def quality(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row of counts and verdicts per row of ``docs(doc_id, text)``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word
    windows. ``kept``: not so, at most ``max_covered`` of the words in repeats of
    ``MIN_REPEAT`` or more words, and no repeat of over ``max_repeat`` words. A
    null or empty text has no words and fails; null ids and repeated rows are
    rows like any other; further columns are ignored.
    """
    rows = docs.select("doc_id", counts_column(F.col("text")).alias("c")).select("doc_id", "c.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeated = (F.col("n_covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeated)
