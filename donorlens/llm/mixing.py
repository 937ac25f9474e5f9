"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: every source has a weight (by default 5, 2, 1, repeating in source
order) and its weight's share of all words, but at most ``MAX_EPOCHS`` times its
own words; what a source cannot take is reshared by weight among the others.

Rows: a keyed hash permutes each source's documents and cuts them into ``BLOCKS``
blocks. A source is taken ``floor(target / size)`` whole times; of its rows, the
share that is then missing is taken once more. Which ones is decided by size
class (powers of two), the largest first: of each class the rows ahead of a place
in the permutation, as many as the class's share of the words still wanted, more
where the smaller classes could not fill what is left, so what a class leaves open
is filled by the smaller ones. The places are found in three steps of a fixed
number of sums: blocks, blocks within the two at the cut, rows within those. In the
last one, of the ``AROUND`` rows on both sides of all cuts those are taken whose
sum comes nearest to what is wanted. So a source misses its target by less than a
small document, whatever its largest. Of ``n`` equal rows their share of ``n`` is
taken, and one more or not like any row.

Output shards: a source's block quota is the number of blocks it takes, repeats
counted. A binary tree over the shards splits the vector of all quotas: each
node draws the left half's quotas from a multivariate hypergeometric
distribution, seeded by the node, so every quota is dealt out exactly. A shard
then draws the next run of each source's permuted blocks, disjoint from all
other shards, and is shuffled locally by hash. Sources beyond ``CHUNK`` go to
trees of their own.

Only sums reach the driver, one row per range of sources. A hot source meets only
partial aggregation; what is gathered per source is one sum per size class and
block, and rows of two blocks' blocks (one row in half a million).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import position, ranged, shuffle_partitions, staged, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
CHUNK = 4096
SHARDS = 16
AROUND = 3
COPIES = 8192
SEED = 10
_PRIME = 1_000_003  # larger than any quota of one source, so multiplying by it permutes the blocks
_TOP = (1 << 63) - 1


def _hash():
    """A row's place in its source's permutation: 63 random bits of id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "source", "text"), 1)


def _added(batches):
    """The sums of both columns over a task's rows, a row for each task: no exchange, so one job."""
    taken, open_ = 0, 0.0
    for b in batches:
        taken += pc.sum(b.column(0)).as_py() or 0
        open_ += pc.sum(b.column(1)).as_py() or 0.0
    yield pa.RecordBatch.from_arrays([pa.array([taken], pa.int64()), pa.array([open_], pa.float64())], names=["taken", "open"])


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """``sources(source, source_size, again, ...)``, one row each, with ``rank`` and ``target``; and the sum of ``again``."""
    parts, starts = ranged(sources, [F.col("source").asc_nulls_last()], F.sum("source_size").alias("size"), F.sum("again"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    # every round below reads it, and the cuts do: written once
    src = staged(position(parts, starts).withColumn("weight", weight), "ranked")
    n, total = sum(s[2] for s in starts), sum(s[3] or 0 for s in starts)
    rounds, rest = divmod(n, len(weights))
    level = total / (rounds * sum(weights) + sum(weights[:rest])) if total else 0.0
    # the common level (words per unit of weight) rises until no further source is capped
    while total:
        full = F.col("source_size") * max_epochs <= F.col("weight") * F.lit(level)
        sums = src.select(F.when(full, F.col("source_size") * max_epochs).cast("long").alias("taken"),
                          F.when(~full, F.col("weight")).alias("open")).mapInArrow(_added, "taken long, open double").collect()
        taken, open_ = sum(r["taken"] for r in sums), sum(r["open"] for r in sums)
        if not taken or not open_ or (total - taken) / open_ <= level:
            break
        level = (total - taken) / open_
    target = F.least(F.col("source_size") * float(max_epochs), F.col("weight") * F.lit(float(level)))
    return src.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("weight"), sum(s[4] or 0 for s in starts)


# ---- the tree over the shards -------------------------------------------------


def splitting_tree(quotas: np.ndarray, shards: int, seed: int | list[int] = SEED) -> np.ndarray:
    """Exact random division of the quotas (one per source) among ``shards`` shards."""
    out = np.zeros((len(quotas), shards), np.int64)
    seeds = [seed] if isinstance(seed, int) else list(seed)

    def split(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = left
            return
        mid = (lo + hi) // 2
        total = int(left.sum())
        rng = np.random.default_rng([*seeds, lo, hi])
        drawn = rng.multivariate_hypergeometric(left, total * (mid - lo) // (hi - lo), method="marginals")
        split(lo, mid, drawn)
        split(mid, hi, left - drawn)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _tree_of(shards: int):
    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        ends = splitting_tree(pdf["quota"].to_numpy(), shards, [SEED, int(pdf["chunk"].iloc[0])]).cumsum(1)
        return pd.DataFrame({"r": pdf["rank"].to_numpy(), "run_ends": ends.tolist()})

    return runs


# ---- which rows are taken once more -----------------------------------------


def cut_classes(left: float, classes: list[list[int]]) -> list[int]:
    """How many parts each class gives, of ``classes`` (the words of their parts, the largest class first):
    its share of what is wanted, and more where the smaller classes cannot fill the rest."""
    below = float(sum(map(sum, classes)))
    out = []
    for words in classes:
        total = float(sum(words))
        share = total if left >= below else left * total / below
        below -= total
        ends = np.cumsum(words)
        k = int(np.searchsorted(ends, share, "right"))
        while k < len(words) and left - (ends[k - 1] if k else 0) > below and ends[k] <= left:
            k += 1
        left -= float(ends[k - 1]) if k else 0.0
        out.append(k)
    return out


def nearest_sum(left: float, sizes: list[int]) -> list[int]:
    """The numbers of ``sizes`` whose sum comes nearest to ``left``, over all choices (in units of
    a four-millionth of their sum, at least one): reachable sums are the bits of a number."""
    unit = max(1, sum(sizes) >> 22)
    reach = [1]
    for s in sizes:
        reach.append(reach[-1] | reach[-1] << round(s / unit))
    want = max(round(left / unit), 0)
    under = reach[-1] & ((1 << want + 1) - 1)
    over = reach[-1] >> want + 1
    at = under.bit_length() - 1
    if over and (over & -over).bit_length() < want - at:
        at = want + (over & -over).bit_length()
    out = []
    for i in reversed(range(len(sizes))):
        if not reach[i] >> at & 1:
            out.append(i)
            at -= round(sizes[i] / unit)
    return out


_STATE = "struct<left:double,cuts:array<struct<cls:int,cut:bigint>>,opened:array<struct<cls:int,part:bigint>>,extra:array<bigint>>"


def decide(left: float, cuts: list, parts: list, level: int) -> dict:
    """One source's cuts after a step: the place up to which a class's rows are taken, and the parts
    around it that the next step looks into; in the last one the single rows that complete the sum."""
    shift = 63 - BLOCK_BITS * level if level < 3 else 0
    classes: dict[int, list] = {}
    for cls, part, words in sorted((-p["cls"], p["part"], p["words"]) for p in parts or ()):
        classes.setdefault(-cls, []).append((part, words))
    taken = cut_classes(left, [[w for _, w in own] for own in classes.values()])
    held, opened, rows = {c["cls"]: c["cut"] for c in cuts or ()}, [], []
    for (cls, own), k in zip(classes.items(), taken):
        first = max(k - (1 if level < 3 else AROUND), 0)
        left -= sum(w for _, w in own[:first])
        held[cls] = own[first][0] << shift
        opened += [{"cls": cls, "part": part} for part, _ in own[first:k + 1]]
        rows += own[first:k + AROUND]
    extra = [rows[i][0] for i in nearest_sum(left, [w for _, w in rows])] if level == 3 else []
    return {"left": left, "cuts": [{"cls": c, "cut": h} for c, h in held.items()], "opened": opened, "extra": extra}


def _decided(level: int):
    pair = [("cls", pa.int32())]
    kind = pa.struct([("left", pa.float64()), ("cuts", pa.list_(pa.struct([*pair, ("cut", pa.int64())]))),
                      ("opened", pa.list_(pa.struct([*pair, ("part", pa.int64())]))), ("extra", pa.list_(pa.int64()))])

    @F.arrow_udf(_STATE)
    def decided(left: pa.Array, cuts: pa.Array, parts: pa.Array) -> pa.Array:
        return pa.array([decide(*x, level) for x in zip(left.to_pylist(), cuts.to_pylist(), parts.to_pylist())], kind)

    return decided(F.col("left"), F.col("cuts"), F.col("parts"))


def _classed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("cls", F.length(F.bin("size")) - 1)


def _cuts(entries: DataFrame, state: DataFrame) -> DataFrame:
    """``state(source, left, parts, ...)``, with the sums of the first step, completed by ``cuts`` and ``extra``: a row
    of ``entries(source, h, size)`` is taken if its ``h`` is below its class's cut, or in ``extra``."""
    rows = _classed(entries).filter("size > 0")
    keep = [c for c in state.columns if c not in ("source", "left", "parts")]
    state = state.withColumn("cuts", F.array().cast("array<struct<cls:int,cut:bigint>>"))
    state = staged(state.withColumn("d", _decided(1)).select("source", *keep, "d.*"), "cuts1")
    for level in (2, 3):
        at = state.select(F.col("source").alias("s"), F.explode("opened").alias("o")).select(
            "s", F.col("o.cls").alias("c"), F.col("o.part").alias("p"))
        near = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c"))
                         & (F.shiftright("h", 63 - BLOCK_BITS * (level - 1)) == F.col("p")))
        if level == 2:
            near = near.groupBy("source", "cls", F.shiftright("h", 63 - BLOCK_BITS * level).alias("part")).agg(
                F.sum("size").alias("words"))
        else:
            near = near.select("source", "cls", F.col("h").alias("part"), F.col("size").alias("words"))
        # one row per source: its state, and the sums it asked for
        both = near.select("source", F.struct("cls", "part", "words").alias("e"), F.lit(None).alias("st")).unionByName(
            state.select("source", F.lit(None).alias("e"), F.struct(*keep, "left", "cuts").alias("st")))
        per = both.groupBy("source").agg(F.first("st", ignorenulls=True).alias("st"), F.collect_list("e").alias("parts"))
        state = staged(per.select("source", "st.*", "parts").withColumn("d", _decided(level)).select(
            "source", *keep, "d.*"), f"cuts{level}")
    return state.drop("left", "opened")


def _numbered(own: DataFrame, repeats: DataFrame) -> DataFrame:
    """``(row_id, j, more)`` for rows that are repeated: their numbers from 0 among equal ones, dealt
    into groups of about ``COPIES``, and how many of them are taken once more."""
    r = repeats.select(F.col("source").alias("s"), F.col("h").alias("r_h"), "n", "more")
    rows = (own.select("source", "h", "row_id").join(r, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("r_h")))
            .withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / COPIES))).select(
                "s", "h", "bucket", "row_id", "more"))
    first = rows.groupBy("s", "h", "bucket").agg(F.count(F.lit(1)).alias("k")).withColumn("start", F.coalesce(F.sum("k").over(
        Window.partitionBy("s", "h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("s", "h", "bucket").orderBy("row_id")) - 1
    first = first.select(F.col("s").alias("f_s"), F.col("h").alias("f_h"), F.col("bucket").alias("f_b"), "start")
    return (rows.withColumn("j", inside).join(first, F.col("s").eqNullSafe(F.col("f_s")) & (F.col("h") == F.col("f_h"))
                                              & (F.col("bucket") == F.col("f_b")))
            .select(F.col("row_id").alias("r_id"), (F.col("j") + F.col("start")).alias("j"), "more"))


def _taken() -> F.Column:
    """Whether the row's entry is among those taken once more."""
    cut = F.exists("cuts", lambda c: (c["cls"] == F.length(F.bin("size")) - 1) & (F.col("h") < c["cut"]))
    return (F.col("size") > 0) & (cut | F.array_contains("extra", F.col("h")))


def mixture(docs: DataFrame, shards: int = SHARDS, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
            carry: list[str] | None = None) -> DataFrame:
    """``(row, size, source_size, target, copies, shards)`` for every row of ``docs``.

    ``row`` is a struct of the columns ``carry`` (all of them by default, under
    whatever names), ``copies`` is how often the mix takes the row, ``shards`` the
    output shard of each copy. Needs the columns ``doc_id, source, text``; nulls are
    allowed in all (null text: size 0; null source: the last source). Each repeat of
    a row has a place of its own; which of them are taken once more is the same
    for all that equal rows can tell. A source without any word takes no row. An
    empty table gives no row.
    """
    own = staged(docs.select(F.struct(*(carry or docs.columns)).alias("row"), "source",
                             word_count(F.col("text")).alias("size"), _hash().alias("h"),
                             F.monotonically_increasing_id().alias("row_id")), "rows")
    entries = staged(own.groupBy("source", "h").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n")), "entries")
    sums = _classed(entries).groupBy("source", "cls", F.shiftright("h", 63 - BLOCK_BITS).alias("part")).agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("n")).alias("all"), F.sum(F.col("n") - 1).alias("again"))
    sources = staged(sums.groupBy("source").agg(
        F.sum("all").alias("source_size"), F.sum("again").alias("again"),
        F.collect_list(F.when(F.col("words") > 0, F.struct("cls", "part", "words"))).alias("parts")), "sources")
    src, again = source_targets(sources, weights, max_epochs)
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    src = src.withColumn("whole", whole).withColumn(
        "share", F.when(size > 0, F.greatest(F.col("target") / size - F.col("whole"), F.lit(0.0))).otherwise(0.0))
    src = src.withColumn("partial", F.ceil(F.col("share") * BLOCKS)).withColumn(
        "quota", F.col("whole") * BLOCKS + F.col("partial")).withColumn("left", F.col("share") * size).drop("again")
    if again:
        # of equal rows their share is taken outright, so that one of them is left to decide on
        of = src.select(F.col("source").alias("s"), "share")
        outright = F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)
        repeats = staged(entries.filter("n > 1").join(of, F.col("source").eqNullSafe(F.col("s")))
                         .withColumn("outright", outright).drop("s", "share"), "repeats")
        sure = repeats.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("outright") * F.col("size")).alias("sure"))
        src = src.join(sure, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("left", F.greatest(
            F.col("left") - F.coalesce("sure", F.lit(0)), F.lit(0.0))).drop("s", "sure")
    per = _cuts(entries, src.drop("share"))
    chunks = per.select("rank", "quota", F.floor(F.col("rank") / CHUNK).alias("chunk"))
    runs = chunks.groupBy("chunk").applyInPandas(_tree_of(shards), "r long, run_ends array<long>")
    per = per.join(runs, F.col("rank") == F.col("r")).drop("rank", "r").withColumnRenamed("source", "s")
    if again:
        more = F.col("outright") + F.when(_taken(), 1).otherwise(0)
        repeats = repeats.join(per.select("s", "cuts", "extra"), F.col("source").eqNullSafe(F.col("s"))).select(
            "source", "h", "n", more.alias("more"))
        numbered = staged(_numbered(own, repeats), "numbered")
        own = own.join(numbered, F.col("row_id") == F.col("r_id"), "left").withColumn(
            "h", F.when(F.coalesce("j", F.lit(0)) > 0, F.shiftrightunsigned(F.xxhash64("h", "j"), 1)).otherwise(F.col("h")))
        once = F.when(F.col("j").isNull(), _taken()).otherwise(F.col("j") < F.col("more"))
    else:
        once = _taken()
    out = own.join(per, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "copies", F.col("whole") + F.when(once, 1).otherwise(0))
    block = F.shiftright("h", 63 - BLOCK_BITS)
    block_at = F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda p: F.when(
        p < F.col("whole"), p * BLOCKS + block).otherwise(p * BLOCKS + F.pmod(block, F.greatest("partial", F.lit(1)))))
    place = F.transform(block_at, lambda b: F.pmod(b * _PRIME, F.greatest(F.col("quota"), F.lit(1))))
    shard = F.transform(F.when(F.col("copies") > 0, place).otherwise(F.array().cast("array<bigint>")),
                        lambda j: F.size(F.filter("run_ends", lambda end: end <= j)))
    return out.select("row", "size", "source_size", "target", "copies", shard.alias("shards"), "h")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, lanes: int | None = None, **kw) -> DataFrame:
    """The mix itself: each row as often as it is taken, dealt to its shards and there
    in random order; the columns of ``docs``. A shard is dealt in ``lanes`` parts, by
    default as many as spread all shards evenly over the session's shuffle
    partitions, so no task's share depends on the number of shards. Nulls, empty
    texts and repeated rows are taken as ``mixture`` says; no row gives no row."""
    lanes = lanes or -(-8 * shuffle_partitions(docs.sparkSession) // shards)
    taken = mixture(docs, shards, **kw).withColumn("shard", F.explode("shards"))
    taken = taken.withColumn("order", F.xxhash64(F.lit(SEED + 1), "h", "shard"))
    taken = taken.withColumn("lane", F.pmod("order", F.lit(lanes)))
    return taken.repartition("shard", "lane").sortWithinPartitions("shard", "order").select("row.*")
