"""Best-fit packing of token sequences with certified bin counts.

1. Every text becomes token ids, ended by id 0. Texts longer than a sequence are
   cut into whole sequences and a rest; whole pieces need no packing.
2. The other pieces are dealt by hash into partitions of about
   ``PARTITION_SEQUENCES`` sequences, and each is packed by best-fit decreasing.
3. Dual feasible functions give a lower bound of each partition's bin count. A
   partition that meets its bound is certified: no packing of it is shorter.
4. Partitions with a gap release their worst-filled sequences (a fixed share, so
   a task's input stays bounded); the documents released by several partitions
   meet in new partitions and are packed again. A new packing is used only where
   it is shorter. This repeats until no gap or no improvement is left, at most
   ``ROUNDS`` times.

Only piece lengths travel; the tokens themselves never leave the worker that
made them.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import staged
from donorlens.llm.tokens import batches, default_tokenizer, worker_tokenizer

SEQUENCE = 2048
PARTITION_SEQUENCES = 4096
RELEASED_SHARE = 0.25
ROUNDS = 4


def token_pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for every piece of every row."""
    path = tokenizer or default_tokenizer()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))

    @F.arrow_udf("array<struct<start:bigint,length:bigint,crc:bigint>>")
    def pieces(texts: pa.Array) -> pa.Array:
        tok, out = worker_tokenizer(path), []
        for part in batches(texts.cast(pa.large_binary()).to_pylist()):
            for raw in tok.ids(part):
                raw += b"\0\0\0\0"
                n = len(raw) // 4
                out.append([{"start": s, "length": min(sequence, n - s),
                             "crc": zlib.crc32(raw[4 * s:4 * (s + sequence)])} for s in range(0, n, sequence)])
        return pa.array(out, kind)

    return (docs.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("piece", "p"))
            .select("doc_id", "piece", "p.start", "p.length", F.col("p.crc").alias("ids_crc32")))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ties go to the fuller bin, then to the later one."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has room r
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        with_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A bin count that no packing can beat, by dual feasible functions of the lengths."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    words = count * size
    best = -(-int(words.sum()) // capacity)
    # items above capacity - e count whole, items under e not at all
    whole, some = count.cumsum(), words.cumsum()
    for e in range(1, capacity // 2 + 1):
        top = int(whole[-1] - whole[capacity - e])
        middle = int(some[capacity - e] - some[e - 1])
        best = max(best, top - (-middle // capacity))
    # rounding to (k+1)-ths: an exact multiple keeps its size, the rest round down to k-ths
    for k in range(1, 41):
        exact = (k + 1) * size % capacity == 0
        down = int((count * ((k + 1) * size // capacity))[~exact].sum())
        kept = int(words[exact].sum())
        best = max(best, math.ceil(Fraction(down, k) + Fraction(kept, capacity)))
    # items over one half are measured by the steps they leave, smaller ones by the steps they fill
    for e in range(2, capacity // 2 + 1, 7):
        steps = capacity // e
        value = np.where(2 * size > capacity, steps - (capacity - size) // e, size // e)
        halves = int(count[capacity // 2]) if capacity % 2 == 0 else 0
        total = int((count * value).sum()) - (halves * int(value[capacity // 2]) if halves else 0)
        best = max(best, math.ceil(Fraction(total, steps) + Fraction(halves, 2)))
    return best


def _pack(pdf: pd.DataFrame, capacity: int, round_: int, released_share: float) -> pd.DataFrame:
    """One partition: pack, compare with what was, certify, choose what to release."""
    part = int(pdf["part"].iloc[0])
    pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True])
    lengths = pdf["length"].to_numpy()
    bound = lower_bound(lengths, capacity)
    was = pdf["sequence_id"].nunique() if round_ else len(pdf) + 1
    bins, offsets = best_fit_decreasing(lengths, capacity)
    used = int(bins.max()) + 1
    if used < was:
        pdf["sequence_id"] = (round_ << 56) + (part << 24) + bins
        pdf["offset"] = offsets
    used = min(used, was)
    certified = used <= bound
    pdf["certified"] = certified
    pdf["release"] = False
    if not certified:
        fill = pdf.groupby("sequence_id")["length"].sum().sort_values(kind="stable")
        fill = fill[fill < capacity]
        worst = fill.index[:max(2, math.ceil(len(fill) * released_share))]
        pdf["release"] = pdf["sequence_id"].isin(worst)
    return pdf


def _packer(capacity: int, round_: int, released_share: float):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, capacity, round_, released_share)

    return packed


def pack(pieces: DataFrame, capacity: int = SEQUENCE, partition_sequences: int = PARTITION_SEQUENCES,
         rounds: int = ROUNDS, released_share: float = RELEASED_SHARE) -> DataFrame:
    """``pieces`` with ``sequence_id, offset, certified``; every piece in one place,
    offsets gapless from 0 in each sequence."""
    whole = (pieces.filter(F.col("length") == capacity)
             .withColumn("sequence_id", -1 - F.monotonically_increasing_id())
             .withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True)))
    rest = pieces.filter(F.col("length") < capacity)
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, part long, sequence_id long, "
              "offset long, certified boolean, release boolean")
    done = []
    todo = rest.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    for k in range(rounds):
        tokens = todo.agg(F.sum("length")).first()[0]
        if not tokens:
            break
        parts = max(1, math.ceil(tokens / (capacity * partition_sequences)))
        # released sequences move whole: either all of their pieces are packed anew, or none
        place = F.xxhash64(F.lit(k), "sequence_id") if k else F.xxhash64("doc_id", "piece", "ids_crc32", "length")
        if not k:  # exact copies are dealt apart
            place = F.xxhash64(place, F.monotonically_increasing_id())
        dealt = todo.withColumn("part", F.pmod(place, F.lit(parts)))
        packed = staged(dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "part", "sequence_id", "offset")
                        .groupBy("part").applyInPandas(_packer(capacity, k, released_share), schema), f"packed{k}")
        last = k == rounds - 1 or parts == 1
        done.append(packed if last else packed.filter(~F.col("release")))
        if last:
            break
        todo = packed.filter("release").drop("certified", "release", "part")
    out = whole
    for d in done:
        out = out.unionByName(d.drop("part", "release"))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    certified)`` for every piece of every row of ``docs``.

    A null or empty text is the single id 0. Repeated rows are packed as often
    as they occur; null ids stay null. Columns other than ``doc_id`` and ``text``
    are ignored; an empty table gives no row.
    """
    return pack(staged(token_pieces(docs, tokenizer), "pieces"))
