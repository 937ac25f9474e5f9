"""Removal of repeated passages with a logarithmic family of suffix arrays.

Every string of ``LENGTH`` bytes that starts at more than one place of the corpus
is found, and the bytes it covers are removed from all its places.

Sampled suffixes. Within the first ``WINDOW`` positions of a string, the 8-byte
piece with the smallest hash names the string's anchor. Equal strings have equal
anchors, so only suffixes at anchors (about one in ``WINDOW / 2`` positions) are
indexed; an anchor answers for the run of strings that chose it, and its context
is the bytes of that run. An anchor's key is a hash of the ``CHUNK`` bytes that
follow it, which lie inside all of its strings.

1. Keys met once cannot belong to a repeated string and leave. If all places of a
   key have one and the same context, its strings are repeated as a whole.
2. The other contexts, one row for each distinct one with its number of places,
   are dealt into batches. A batch gets a suffix array: its contexts sorted by
   what follows the anchor, within their key. It is merge-scanned with the
   existing levels: in the merged order, longest common prefixes behind the
   anchor and, in a second order, longest common suffixes before it tell for
   every offset which contexts hold the same string.
3. A scanned batch becomes a level; levels of equal size merge into one of twice
   the size, so a context is rewritten once per size, log(batches) times.
   Levels are Parquet tables in the shared checkpoint folder, dealt by key.
4. Keys with over ``HOT`` distinct contexts (a passage that very many texts share,
   each with another continuation) are not gathered into one task: their strings
   are compared by 128-bit hashes in a plain aggregation, which spreads them.
5. The spans found go back to the texts, which are cut and hashed there.

Only keys, hashes and contexts of repeated keys are shuffled, and each text
twice to meet its positions. No stage runs more than one Python function, and
these read a batch text by text.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import shuffle_partitions, staged

LENGTH = 400
WINDOW = 320
CHUNK = 80
BATCHES = 4
HOT = 20_000
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 30) - 1)


def anchors(data: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple:
    """``(anchor, first, last)``: the anchors of a text, each with the first and last
    start of the strings that it answers for. Every start has exactly one anchor."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    raw = np.frombuffer(data, np.uint8)
    pieces = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), shape=(n - 7,), strides=(1,))
    h = pieces[:n - length + window] * _MIX1
    h ^= h >> np.uint64(29)
    h *= _MIX2
    low = (h & ~_PLACE) | (np.arange(len(h), dtype=np.uint64) & _PLACE)  # ties: the first place
    size = 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[:size - window], low[window - size:])
    at = (low & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:] - 1, len(at) - 1]


def _anchor_column(text):
    """Array of (key, cid, a, before, least) for a text: before and least are the
    largest and smallest distance from a string's start to the anchor."""

    @F.arrow_udf("array<struct<key:bigint,cid:bigint,a:int,before:int,least:int>>")
    def found(texts: pa.Array) -> pa.Array:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        key, cid, at, before, least, ends = array("Q"), array("Q"), array("i"), array("i"), array("i"), [0]
        for text in texts.cast(pa.large_binary()):
            t = text.as_py() or b""
            for a, lo, hi in zip(*(x.tolist() for x in anchors(t))):
                key.append(digest(t[a:a + CHUNK]))
                cid.append(digest(t[lo:hi + LENGTH], a - lo))
                at.append(a)
                before.append(a - lo)
                least.append(a - hi)
            ends.append(len(key))
        columns = [pa.array(np.array(x, k)) for x, k in zip((key, cid, at, before, least), (*2 * [np.uint64], *3 * [np.int32]))]
        columns[:2] = [c.view(pa.int64()) for c in columns[:2]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            columns, names=["key", "cid", "a", "before", "least"]))

    return found(text)


# ---- merge-scan of sorted contexts ------------------------------------------


def _neighbours(rows: list[bytes], order: np.ndarray, width: int) -> np.ndarray:
    """Longest common prefix of each row with the one before it in ``order`` (0 for the first)."""
    size = np.array([len(rows[i]) for i in order])
    flat = np.zeros((len(order), width + 1), np.uint8)
    for k, i in enumerate(order):
        r = rows[i][:width]
        flat[k, :len(r)] = np.frombuffer(r, np.uint8)
    differ = flat[1:] != flat[:-1]
    differ[:, width] = True
    lcp = np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1]))
    return np.r_[0, lcp]


def repeated_offsets(key: np.ndarray, n: np.ndarray, before: np.ndarray, least: np.ndarray,
                     context: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context the runs of offsets (start to anchor) whose string is found
    more than once among the contexts of its key, places counted by ``n``."""
    count = len(key)
    right = [c[b:] for c, b in zip(context, before.tolist())]
    left = [c[:b][::-1] for c, b in zip(context, before.tolist())]
    classes = []
    for part, width in ((right, length), (left, int(before.max(initial=0)) + 1)):
        order = np.array(sorted(range(count), key=lambda i: (key[i], part[i])), np.int64)  # the suffix array
        lcp = _neighbours(part, order, width)
        lcp[1:][key[order][1:] != key[order][:-1]] = -1
        lcp[:1] = -1
        classes.append((order, lcp))
    low, high = int(least.min()), int(before.max())
    hits = np.zeros((count, high - low + 2), bool)
    label = [np.empty(count, np.int64), np.empty(count, np.int64)]
    for o in range(low, high + 1):
        own = np.flatnonzero((least <= o) & (o <= before))
        if not len(own):
            continue
        for k, need in ((0, length - o), (1, o)):
            order, lcp = classes[k]
            label[k][order] = np.cumsum(lcp < need)
        code = label[0][own] * (count + 1) + label[1][own]
        _, inverse = np.unique(code, return_inverse=True)
        hits[own, o - low] = (np.bincount(inverse, weights=n[own]) >= 2)[inverse]
    edge = np.diff(np.pad(hits, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(count)]
    starts, stops = np.nonzero(edge == 1), np.nonzero(edge == -1)
    for i, lo, hi in zip(starts[0].tolist(), starts[1].tolist(), stops[1].tolist()):
        out[i].append((lo + low, hi - 1 + low))
    return out


_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_FOUND = pa.schema([("key", pa.int64()), ("cid", pa.int64()), ("runs", _RUNS)])


def _scan(batches, most: int = 8_000):
    """Contexts sorted by key -> ``(key, cid, runs)``; only keys with a new context are compared."""
    held: list[dict] = []
    size = 0

    def work(rows: dict):
        key = np.array(rows["key"], np.int64)
        fresh = np.unique(key[np.array(rows["fresh"], bool)])
        use = np.flatnonzero(np.isin(key, fresh))
        if not len(use):
            return None
        pick = {c: [rows[c][i] for i in use.tolist()] for c in rows}
        runs = repeated_offsets(key[use], np.array(pick["n"], np.float64), np.array(pick["before"], np.int64),
                                np.array(pick["least"], np.int64), pick["context"])
        keep = [i for i, r in enumerate(runs) if r]
        return pa.record_batch([
            pa.array([pick["key"][i] for i in keep], pa.int64()), pa.array([pick["cid"][i] for i in keep], pa.int64()),
            pa.array([[{"lo": a, "hi": b} for a, b in runs[i]] for i in keep], _RUNS)], schema=_FOUND)

    def joined() -> dict:
        return {c: [x for h in held for x in h[c]] for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch.to_pydict())
        size += batch.num_rows
        if size >= most:
            rows = joined()
            key = np.array(rows["key"], np.int64)
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                done = work({c: v[:cut] for c, v in rows.items()})
                if done is not None:
                    yield done
            held = [{c: v[cut:] for c, v in rows.items()}]
            size -= cut
    if held:
        done = work(joined())
        if done is not None:
            yield done


class Family:
    """Levels of sorted contexts; ``add`` scans a batch against them and takes it in.

    A batch is a frame ``(key, cid, n, before, least, context)``. ``add`` returns
    ``(key, cid, runs)`` for the batch's and the levels' contexts that hold a string
    repeated in the batch or between it and a level.
    """

    COLUMNS = ("key", "cid", "n", "before", "least", "context")

    def __init__(self, partitions: int):
        self.partitions = partitions
        self.levels: list[tuple[int, DataFrame]] = []

    def _sorted(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.partitions, "key").sortWithinPartitions("key", "cid")

    def _one_per_context(self, df: DataFrame) -> DataFrame:
        return df.groupBy("key", "cid").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in self.COLUMNS[3:]])

    def add(self, batch: DataFrame) -> DataFrame:
        batch = batch.select(*self.COLUMNS)
        every = batch.withColumn("fresh", F.lit(True))
        for _, level in self.levels:
            every = every.unionByName(level.withColumn("fresh", F.lit(False)))
        found = staged(self._sorted(every).mapInArrow(
            _scan, "key bigint, cid bigint, runs array<struct<lo:int,hi:int>>"), "found")
        size, new = 1, batch
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            new = new.unionByName(level)
            size *= 2
        if size > 1:
            new = self._one_per_context(new)
        self.levels.append((size, staged(new, f"level{size}")))
        return found


# ---- the whole corpus --------------------------------------------------------


def _window_hashes():
    """The 128-bit hash of every string of a context, as (offset, two longs)."""

    @F.arrow_udf("array<struct<o:int,h1:bigint,h2:bigint>>")
    def each(context: pa.Array, before: pa.Array, least: pa.Array) -> pa.Array:
        import xxhash

        at, halves, ends = array("i"), bytearray(), [0]
        for c, b, low in zip(context, before.to_pylist(), least.to_pylist()):
            data = c.as_py()
            for o in range(low, b + 1):
                halves += xxhash.xxh3_128_digest(data[b - o:b - o + LENGTH])
            at.extend(range(low, b + 1))
            ends.append(len(at))
        h = np.frombuffer(bytes(halves), "<i8").reshape(-1, 2)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(np.array(at, np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["o", "h1", "h2"]))

    return each(F.col("context"), F.col("before"), F.col("least"))


def _hot_runs(contexts: DataFrame) -> DataFrame:
    """``(key, cid, runs)`` by comparing every string's hash: no key is gathered in one place."""
    each = contexts.select("key", "cid", "n", F.explode(_window_hashes()).alias("w")).select(
        "key", "cid", "n", "w.o", "w.h1", "w.h2")
    twice = each.groupBy("o", "h1", "h2").agg(F.sum("n").alias("total")).filter("total > 1").drop("total")
    return (each.join(twice, ["o", "h1", "h2"], "left_semi").groupBy("key", "cid")
            .agg(F.collect_list(F.struct(F.col("o").alias("lo"), F.col("o").alias("hi"))).alias("runs")))


def _cut_text():
    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        n_bytes, n_removed, n_runs, digest, remain = [], [], [], [], []
        for text, ss in zip(texts.cast(pa.large_binary()), spans):
            t = text.as_py()
            kept, end, removed, runs = [], -1, 0, 0
            for start, stop in sorted((s["start"], s["end"]) for s in ss.as_py() or ()):
                if start > end:  # spans that touch are one run
                    kept.append(t[max(end, 0):start])
                    runs += 1
                    removed += stop - start
                    end = stop
                elif stop > end:
                    removed += stop - end
                    end = stop
            rest = b"".join([*kept, t[max(end, 0):]]) if runs else t
            n_bytes.append(len(t))
            n_removed.append(removed)
            n_runs.append(runs)
            digest.append(hashlib.sha256(rest).hexdigest())
            remain.append(rest)
        longs = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_runs)]
        return pa.StructArray.from_arrays([*longs, pa.array(digest, pa.string()), pa.array(remain, pa.binary())], names=[
            "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut(F.col("text"), F.col("spans"))


def as_text(kept):
    """Remaining bytes as text; bytes of characters that were cut through become U+FFFD."""
    return F.make_valid_utf8(kept.cast("string"))


def repeated_spans(docs: DataFrame, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """``(doc, size, spans)``: byte spans of repeated strings, for texts (by hash and
    size) that have any. Rows that repeat a text and id share one entry."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    sampled = (docs.filter(F.octet_length("text") >= LENGTH)
               .select("doc", "size", F.explode(_anchor_column(F.col("text"))).alias("p"))
               .select("p.key", "p.cid", "doc", "size", "p.a", "p.before", "p.least"))
    # written out, so that the join has a plain exchange on both sides and AQE can split a hot key
    twice = staged(sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "twice")
    places = staged(sampled.join(twice, "key", "left_semi"), "places")
    contexts = staged(places.groupBy("key", "cid").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "size", "a", "before", "least")).alias("at")), "contexts")
    kinds = staged(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    mixed = contexts.join(kinds.filter("kinds > 1"), "key").select(
        "key", "cid", "n", "at.*", (F.col("kinds") > hot).alias("hot"))
    asked = mixed.groupBy("doc", "size").agg(  # at most a text's own anchors
        F.collect_list(F.struct("key", "cid", "n", "a", "before", "least", "hot")).alias("places"))
    one = docs.filter(F.octet_length("text") >= LENGTH).select("doc", "size", "text").join(asked, ["doc", "size"])
    context = F.substring(F.col("text").cast("binary"), F.col("p.a") - F.col("p.before") + 1,
                          F.col("p.before") - F.col("p.least") + LENGTH)
    rows = (one.dropDuplicates(["doc", "size"]).select("doc", "text", F.explode("places").alias("p"))
            .select("doc", "p.*", context.alias("context")))
    rows = staged(rows, "mixed")
    family = Family(parts)
    found = [_hot_runs(rows.filter("hot"))]
    usual = rows.filter("not hot")
    for b in range(batches):
        found.append(family.add(usual.filter(F.pmod(F.xxhash64("doc", F.lit(6)), F.lit(batches)) == b)))
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    runs = runs.select("key", "cid", F.explode("runs").alias("r")).select("key", "cid", "r.lo", "r.hi").distinct()
    whole = kinds.filter("kinds = 1").select("key").join(contexts, "key").select(
        "key", "cid", F.col("at.least").alias("lo"), F.col("at.before").alias("hi"))
    spans = places.join(whole.unionByName(runs), ["key", "cid"]).select(
        "doc", "size", (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + LENGTH).alias("end"))
    return spans.distinct().groupBy("doc", "size").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """One row ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` per row of ``docs``; ``kept``
    holds the bytes that remain (a removed run may begin or end within a character).

    Exact copies of a text, also rows that repeat, are all removed where they
    are ``LENGTH`` bytes or longer: a string counts as repeated wherever it
    starts a second time. A null text is empty; shorter texts lose nothing; null
    ids are allowed; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"), F.octet_length("text").alias("size"))
    spans = repeated_spans(own, batches, hot)
    return own.join(spans, ["doc", "size"], "left").select("doc_id", _cut_text().alias("c")).select("doc_id", "c.*")
