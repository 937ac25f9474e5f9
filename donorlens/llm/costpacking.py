"""Packing of token sequences to full length with balanced attention cost.

A piece of ``n`` tokens costs ``n + n * n / (6 * HIDDEN)``: the linear part of a
transformer layer (projections and feed-forward, 24 h^2 per token) and its
attention within the piece (4 h n per token), in units of the linear part.

1. Every text becomes token ids, ended by id 1. Texts longer than a sequence are
   cut into whole sequences and a rest.
2. The rests, their ids with them, are dealt by hash into partitions bounded in
   tokens and in rows. A partition of ``T`` tokens opens ``T // 2048`` sequences.
   Its pieces, longest first, go each to the sequence of lowest cost that still
   has room for the whole piece; what fits nowhere is cut at the end along the
   rooms that are left, the largest first, so every sequence is full.
3. The under 2048 tokens that a partition has left over go on to the next, far
   smaller round. In the last one they fill sequences whose lengths are the
   powers of two that make up their number, which need no padding.

So no sequence is padded at all, and no task holds more than one bounded
partition.
"""

from __future__ import annotations

import zlib
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import shuffle_partitions, staged
from donorlens.llm.tokens import batches, default_tokenizer, worker_tokenizer

SEQUENCE = 2048
HIDDEN = 1024
PARTITION_SEQUENCES = 1024
PARTITION_ROWS = 65536
END = 1


def cost(length, hidden: int = HIDDEN):
    """Linear plus quadratic cost of a piece, in units of one token's linear cost."""
    return length * (1 + length / (6 * hidden))


def token_rests(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """``(doc_id, doc_tokens, start, length, crc, ids)`` for the whole sequences (without
    ids) and the rest of every row; ``ids`` are little-endian unsigned 16-bit integers, or
    32-bit ones where the vocabulary is larger than that."""
    path = tokenizer or default_tokenizer()
    end = np.array([END], "<u4").tobytes()

    @F.arrow_udf("array<struct<doc_tokens:bigint,start:bigint,length:bigint,crc:bigint,ids:binary>>")
    def pieces(texts: pa.Array) -> pa.Array:
        tok = worker_tokenizer(path)
        kind = id_type(tok)
        total, starts, lengths, crcs, ids, ends = [], [], [], [], [], [0]
        for part in batches(texts.cast(pa.large_binary()).to_pylist()):
            for raw in tok.ids(part):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, sequence):
                    own = raw[4 * s:4 * (s + sequence)] if n > sequence else raw
                    total.append(n)
                    starts.append(s)
                    lengths.append(len(own) // 4)
                    crcs.append(zlib.crc32(own))
                    whole = len(own) == 4 * sequence
                    ids.append(None if whole else own if kind == "<u4" else np.frombuffer(own, "<u4").astype(kind).tobytes())
                ends.append(len(starts))
        longs = [pa.array(x, pa.int64()) for x in (total, starts, lengths, crcs)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [*longs, pa.array(ids, pa.binary())], names=["doc_tokens", "start", "length", "crc", "ids"]))

    return (docs.select("doc_id", F.explode(pieces(F.col("text"))).alias("p"))
            .select("doc_id", "p.doc_tokens", "p.start", "p.length", "p.crc", "p.ids"))


def id_type(tok) -> str:
    """How a tokenizer's ids are kept: in two bytes where they fit."""
    return "<u2" if tok.full.get_vocab_size() <= 1 << 16 else "<u4"


class Sequences:
    """Open sequences by room; the cheapest with room for a length is found in a tree of minima over the rooms."""

    def __init__(self, capacities: list[int]):
        self.most = max(capacities, default=0)
        self.size = 1 << self.most.bit_length()
        self.by_room: list[list] = [[] for _ in range(self.size)]
        self.least = [np.inf] * (2 * self.size)
        self.room, self.cost = list(capacities), [0.0] * len(capacities)
        for b, room in enumerate(capacities):
            heappush(self.by_room[room], (0.0, b))
        for room in set(capacities):
            self._refresh(room)

    def _refresh(self, room: int) -> None:
        least, at = self.least, room + self.size
        held = self.by_room[room]
        least[at] = held[0][0] if held else np.inf
        at >>= 1
        while at:
            a, b = least[2 * at], least[2 * at + 1]
            least[at] = a if a < b else b
            at >>= 1

    def cheapest(self, length: int) -> int | None:
        """The room class that holds the cheapest sequence with room for ``length`` (ties: the least room)."""
        if length > self.most:
            return None
        best, found, least = np.inf, 0, self.least
        lo, hi = length + self.size, 2 * self.size
        while lo < hi:  # nodes that cover the rooms from length on, from left to right
            if lo & 1:
                if least[lo] < best:
                    best, found = least[lo], lo
                lo += 1
            lo >>= 1
            hi >>= 1
        if best == np.inf:
            return None
        while found < self.size:
            found = 2 * found if least[2 * found] == best else 2 * found + 1
        return found - self.size

    def put(self, room: int, length: int, price: float) -> tuple[int, int]:
        """Takes the cheapest sequence of a room class; gives it and the place in it, counted from its end."""
        _, b = heappop(self.by_room[room])
        self._refresh(room)
        self.room[b] -= length
        self.cost[b] += price
        heappush(self.by_room[self.room[b]], (self.cost[b], b))
        self._refresh(self.room[b])
        return b, room


def fill(lengths: np.ndarray, capacities: list[int], hidden: int = HIDDEN) -> list[tuple[int, int, int, int, int]]:
    """``(item, from, length, sequence, offset)`` for items in descending order: each to the
    cheapest sequence with room for it, then those without one cut along the rooms left,
    largest first. What exceeds all rooms has sequence -1. Full unless the items run out."""
    seqs, out, waiting = Sequences(capacities), [], []
    for i, n in enumerate(lengths.tolist()):
        room = seqs.cheapest(n)
        if room is None:
            waiting.append(i)
            continue
        b, had = seqs.put(room, n, cost(n, hidden))
        out.append((i, 0, n, b, capacities[b] - had))
    rooms = sorted(((r, -b) for b, r in enumerate(seqs.room) if r), reverse=True)
    rooms = [(r, -b) for r, b in reversed(rooms)]  # the largest is taken from the end
    for i in waiting:
        at, n = 0, int(lengths[i])
        while at < n and rooms:
            room, b = rooms.pop()
            take = min(room, n - at)
            out.append((i, at, take, b, capacities[b] - room))
            at += take
            if take < room:
                rooms.append((room - take, b))
        if at < n:
            out.append((i, at, n - at, -1, 0))
    return out


_OUT = ("doc_id long, doc_tokens long, start long, length long, crc long, ids binary, sequence_id long, "
        "`offset` long, sequence_tokens long, sequence_cost double")


def _packer(capacity: int, round_: int, last: bool, hidden: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["length", "crc", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        total = int(pdf["length"].sum())
        capacities = [capacity] * (total // capacity)
        if last:  # the rest fills the powers of two that add up to it
            rest = total % capacity
            capacities += [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        placed = np.array(fill(pdf["length"].to_numpy(), capacities, hidden), np.int64).reshape(-1, 5)
        item, frm, n, seq, offset = placed.T
        out = pdf[["doc_id", "doc_tokens", "start", "crc", "ids"]].iloc[item].reset_index(drop=True)
        out["start"] += frm
        out["length"] = n
        whole = pdf["length"].to_numpy()[item]
        ids, crc = out["ids"].tolist(), out["crc"].to_numpy().copy()
        for k in np.flatnonzero(n < whole).tolist():
            width = len(ids[k]) // int(whole[k])
            ids[k] = ids[k][width * frm[k]:width * (frm[k] + n[k])]
            crc[k] = zlib.crc32(np.frombuffer(ids[k], f"<u{width}").astype("<u4").tobytes())
        out["crc"] = crc
        out["ids"] = [None if s >= 0 else x for x, s in zip(ids, seq.tolist())]
        out["sequence_id"] = np.where(seq < 0, -1, (round_ << 56) + (part << 20) + seq)
        out["offset"] = offset
        prices = np.bincount(seq[seq >= 0], cost(n[seq >= 0], hidden), minlength=len(capacities) + 1)
        out["sequence_tokens"] = np.array([*capacities, 0], np.int64)[seq]
        out["sequence_cost"] = prices[seq]
        return out

    return packed


def pack(rests: DataFrame, capacity: int = SEQUENCE, partition_sequences: int = PARTITION_SEQUENCES,
         partition_rows: int = PARTITION_ROWS, hidden: int = HIDDEN) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, sequence_cost)`` of the rows of ``token_rests``; every sequence is
    full, or as long as a power of two. ``partition_sequences`` must be under 2 ** 20."""
    columns = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
               "sequence_tokens", "sequence_cost"]
    out = (rests.filter(F.col("length") == capacity)
           .withColumns({"sequence_id": -2 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
                         "sequence_tokens": F.lit(capacity).cast("long"),
                         "sequence_cost": F.lit(float(cost(capacity, hidden)))}).select(*columns))
    todo, k = rests.filter(F.col("length") < capacity), 0
    tasks = shuffle_partitions(rests.sparkSession)
    while True:
        tokens, rows = todo.agg(F.sum("length"), F.count(F.lit(1))).first()
        if not rows:
            return out
        # a partition holds at least one full sequence, so what it leaves over is less than it got
        parts = max(-(-tokens // (capacity * partition_sequences)), min(-(-rows // partition_rows), tokens // (2 * capacity)), 1)
        place = F.xxhash64("doc_id", "start", "crc", "length", F.monotonically_increasing_id())  # copies are dealt apart
        dealt = todo.select("doc_id", "doc_tokens", "start", "length", "crc", "ids", F.pmod(place, F.lit(parts)).alias("part"))
        packed = staged(dealt.repartition(min(tasks, parts), "part").groupBy("part").applyInPandas(
            _packer(capacity, k, parts == 1, hidden), _OUT), f"packed{k}")
        out = out.unionByName(packed.filter("sequence_id <> -1").select(*columns))
        if parts == 1:
            return out
        todo, k = packed.filter("sequence_id = -1"), k + 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **kw) -> DataFrame:
    """The pieces of all rows of ``docs(doc_id, text)``, see ``pack``.

    A null or empty text is the single id 1. Repeated rows are packed as often as
    they occur; null ids stay null. Further columns are ignored; an empty table
    gives no row.
    """
    return pack(staged(token_rests(docs, tokenizer), "rests"), **kw)
