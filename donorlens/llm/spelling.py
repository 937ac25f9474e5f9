"""Spelling variants grouped with k-d trees over letter-count vectors.

Words are counted over the whole corpus. A word's vector holds how often each
letter occurs in it. One inserted, deleted or replaced letter adds at most one to
one count and takes at most one from another, so near words lie within an L1
distance of two, and in a box that is far narrower: at most one letter more, at
most one letter less. The words of each length form a k-d tree, and each pair of
lengths (own, one longer, one shorter) is one range search per word:

* same length: one letter more and one less; one longer: one more; one shorter:
  one less.

Trees. All trees grow together, one level per step: for each node of more than
``CELL`` words, counts by (node, letter, count) give the split that comes closest
to halving it, and its words move to its halves. A search goes down with the
splits: to its own side, and to the other side if that box is still within reach
of the letters it may gain or lose (``more``, ``less``: the letters used up by
the way taken). No word is compared at this stage.

Cells. The words that end in one cell, and the searches that reach it, dealt into
blocks of at most ``BLOCK`` searches, are one task's group; within it the tree
goes on in memory down to leaves of ``LEAF`` words, all searches together level by
level, and what is left is verified letter by letter. Cells whose words all have
the same vector cannot be split by it; such words (anagrams) are split by a hash
of the word into parts of ``CELL``, each of which every search of the cell reads.

Only counts and the best near word of each search leave a task, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import ascii_lower, shuffle_partitions, staged

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
CELL = 65536
BLOCK = 65536
LEAF = 16
WIDTH = 64
DIMS = 96
MISSPELL = 31


def dimension(code: np.ndarray) -> np.ndarray:
    """A letter's place in the vector: a-z, then the other letters by their lowest six bits. Letters
    that share a place only make the boxes wider."""
    return np.where((code >= 97) & (code < 123), code - 97, 26 + (code & 63))


def runs(text: Column, least: int = LEAST_LETTERS) -> Column:
    """The maximal runs of letters of a text that have ``least`` letters or more, A-Z in lower case."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))


def misspelt(doc_id: Column, run: Column, every: int = MISSPELL) -> Column:
    """``run`` with one letter deleted where ``every`` divides the CRC-32 of ``<doc_id>:<run>`` (null id: empty)."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(crc, F.length(run)).cast("int")
    return F.when(crc % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run))))\
        .otherwise(run)


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                every: int = MISSPELL) -> DataFrame:
    """``(word, n)`` over whole texts. Needs ``doc_id, text``; null texts have no word."""
    each = docs.select("doc_id", F.explode(runs(F.col("text"), least)).alias("run"))
    words = each.select(misspelt(F.col("doc_id"), F.col("run"), every).alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# ---- the trees over all words -----------------------------------------------

_NONE, _SHUT = "", "-"  # no letter used up by the way yet; none to be had
_WAYS = {_NONE: -1, _SHUT: -2}


def _count_of(letter) -> Column:
    """How often the letter occurs in the row's word."""
    return F.length("word") - F.length(F.replace("word", letter, F.lit("")))


def _splits(points: DataFrame, cell: int) -> DataFrame:
    """``(tree, node, letter, cut)`` for nodes of more than ``cell`` words: words with at most ``cut``
    times the letter go left. Nodes of equal vectors have none."""
    sizes = points.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > cell)
    sizes = staged(sizes, "sizes")
    held = points.join(sizes, ["tree", "node"]).select(
        "tree", "node", "size", "word", F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
    counts = held.groupBy("tree", "node", "size", "letter", _count_of(F.col("letter")).alias("c")).agg(
        F.count(F.lit(1)).alias("k"))
    # a letter has few different counts: their totals fit one row
    per = counts.groupBy("tree", "node", "size", "letter").agg(F.collect_list(F.struct("c", "k")).alias("ks"))
    above = F.transform(F.array_append(F.transform("ks", lambda e: e["c"]), F.lit(0)), lambda cut: F.struct(
        cut.alias("cut"), F.aggregate("ks", F.lit(0).cast("long"), lambda s, e: s + F.when(
            e["c"] > cut, e["k"]).otherwise(F.lit(0).cast("long"))).alias("right")))
    cuts = per.select("tree", "node", "size", "letter", F.explode(above).alias("a")).select(
        "tree", "node", "letter", "a.cut", F.col("a.right").alias("right"), "size")
    cuts = cuts.filter((F.col("right") > 0) & (F.col("right") < F.col("size")))
    best = F.min(F.struct(F.abs(2 * F.col("right") - F.col("size")).alias("off"), "letter", "cut")).alias("b")
    return cuts.groupBy("tree", "node").agg(best).select("tree", "node", "b.letter", "b.cut")


def _moved(points: DataFrame, splits: DataFrame) -> DataFrame:
    """Words of split nodes one level down."""
    right = _count_of(F.col("letter")) > F.col("cut")
    return points.join(splits, ["tree", "node"], "left").withColumn(
        "node", F.when(F.col("letter").isNull(), F.col("node")).otherwise(
            2 * F.col("node") + F.when(right, 1).otherwise(0))).drop("letter", "cut")


def _searched(searches: DataFrame, splits: DataFrame) -> DataFrame:
    """Searches one level down: on their own side, and on the other where one letter more or less reaches it.

    ``more`` / ``less``: the letter that the way so far needs once more / once
    less than the word has.
    """
    met = searches.join(splits, ["tree", "node"], "left").withColumn("c", _count_of(F.col("letter")))
    c, a, cut, more, less = (F.col(x) for x in ("c", "letter", "cut", "more", "less"))

    def way(child: int, more, less) -> Column:
        return F.struct((2 * F.col("node") + child).alias("node"), more.alias("more"), less.alias("less"))

    left = F.when((c <= cut) & ((more != a) | (c + 1 <= cut)), way(0, more, less)) \
        .when((c == cut + 1) & less.isin(_NONE, a), way(0, more, a))
    right = F.when((c > cut) & ((less != a) | (c - 1 > cut)), way(1, more, less)) \
        .when((c == cut) & more.isin(_NONE, a), way(1, a, less))
    ways = F.when(a.isNull(), F.array(F.struct("node", "more", "less"))).otherwise(F.array_compact(F.array(left, right)))
    return met.withColumn("w", F.explode(ways)).select("word", "tree", "w.node", "w.more", "w.less")


# ---- within a cell ------------------------------------------------------------


def _vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words their letter codes (0 behind the end), lengths, count vectors, and sets of letters as bits (letters may share one)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(words)), size)
    vec = np.bincount(row * DIMS + dimension(code), minlength=len(words) * DIMS).reshape(-1, DIMS).astype(np.int16)
    bits = np.zeros(len(words), np.uint64)
    for d in range(DIMS):
        bits |= (vec[:, d] > 0).astype(np.uint64) << np.uint64(d % 64)
    codes = np.zeros((len(words), min(int(size.max(initial=0)) + 1, WIDTH)), np.uint32)
    at = np.arange(len(code)) - np.repeat(size.cumsum() - size, size)
    short = at < codes.shape[1]
    codes[row[short], at[short]] = code[short]
    return codes, size, vec, bits


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def one_edits(a: np.ndarray, b: np.ndarray, change: int) -> np.ndarray:
    """``one_edit`` for rows of letter codes, those of ``b`` longer than those of ``a`` by ``change`` (-1, 0 or 1) letters."""
    if not change:
        return (a != b).sum(1) == 1
    short, long = (a, b) if change > 0 else (b, a)
    short = short[:, :-1]
    behind = np.logical_or.accumulate(short != long[:, :-1], axis=1)  # where they part, the longer is one letter on
    return (~behind | (short == long[:, 1:])).all(1)


class CellTree:
    """A k-d tree in memory: per node a split (letter, cut), or a leaf's run of words."""

    def __init__(self, vec: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vec))
        self.letter, self.cut, self.kids, self.run = [], [], [], []
        todo = [(0, len(vec), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            own = self.order[lo:hi]
            at = len(self.letter)
            if parent >= 0:
                self.kids[parent].append(at)
            self.kids.append([])
            self.run.append((lo, hi))
            letter, cut = self._split(vec[own]) if hi - lo > leaf else (-1, 0)
            self.letter.append(letter)
            self.cut.append(cut)
            if letter >= 0:
                right = vec[own, letter] > cut
                self.order[lo:hi] = np.r_[own[~right], own[right]]
                mid = lo + int((~right).sum())
                todo += [(mid, hi, at), (lo, mid, at)]  # the left child is numbered first
        self.letter, self.cut = np.array(self.letter), np.array(self.cut)
        self.kids = np.array([k or [-1, -1] for k in self.kids], np.int64).reshape(-1, 2)
        self.run = np.array(self.run, np.int64).reshape(-1, 2)

    @staticmethod
    def _split(vec: np.ndarray) -> tuple[int, int]:
        best = (len(vec), -1, 0)
        for cut in range(int(vec.max(initial=0))):
            off = np.abs(2 * (vec > cut).sum(0) - len(vec))
            k = int(off.argmin())
            best = min(best, (int(off[k]), k, cut))
        return best[1:] if best[0] < len(vec) else (-1, 0)

    def reached(self, vec: np.ndarray, more: np.ndarray, less: np.ndarray, most: int = 20_000):
        """Yield (search, word) arrays: the words of the leaves that one letter more and one less reach."""
        every = np.arange(len(vec))
        todo = [(every, np.zeros(len(vec), np.int64), more, less)]
        while todo:
            q, node, more, less = todo.pop()
            if len(q) > most:
                h = len(q) // 2
                todo += [(q[:h], node[:h], more[:h], less[:h]), (q[h:], node[h:], more[h:], less[h:])]
                continue
            a, cut = self.letter[node], self.cut[node]
            leaf = a < 0
            if leaf.any():
                lo, hi = self.run[node[leaf]].T
                n = hi - lo
                step = np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n)
                yield np.repeat(q[leaf], n), self.order[np.repeat(lo, n) + step]
            q, node, more, less, a, cut = (x[~leaf] for x in (q, node, more, less, a, cut))
            if not len(q):
                continue
            c = vec[q, a]
            left_free = (c <= cut) & ((more != a) | (c + 1 <= cut))
            left_loss = (c == cut + 1) & ((less == -1) | (less == a))
            right_free = (c > cut) & ((less != a) | (c - 1 > cut))
            right_gain = (c == cut) & ((more == -1) | (more == a))
            left, right = left_free | left_loss, right_free | right_gain
            kids = self.kids[node]
            todo.append((np.r_[q[left], q[right]], np.r_[kids[left, 0], kids[right, 1]],
                         np.r_[more[left], np.where(right_free, more, a)[right]],
                         np.r_[np.where(left_free, less, a)[left], less[right]]))


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _cell_search(points: pa.Table, searches: pa.Table) -> pa.Table:
    """Per search of a cell's block: how many of the cell's words are near, and the best of them."""
    points = sorted(zip(points["n"].to_pylist(), points["word"].to_pylist()), key=lambda p: (-p[0], p[1]))
    texts, asked = [w for _, w in points], searches["asked"].to_pylist()  # a lower number is a better word
    codes, size, vec, bits = _vectors(texts)
    q_codes, q_size, q_vec, q_bits = _vectors(asked)
    width = max(codes.shape[1], q_codes.shape[1])
    codes, q_codes = (np.pad(c, ((0, 0), (0, width - c.shape[1]))) for c in (codes, q_codes))
    near = np.zeros(len(asked), np.int64)
    best = np.full(len(asked), len(texts), np.int64)
    letters = {x: _WAYS.get(x) or int(dimension(np.array(ord(x)))) for c in ("gain", "loss") for x in set(searches[c].to_pylist())}
    more, less = (np.array([letters[x] for x in searches[c].to_pylist()], np.int64) for c in ("gain", "loss"))
    for q, p in CellTree(vec).reached(q_vec, more, less):
        close = np.bitwise_count(q_bits[q] ^ bits[p]) <= 2  # one letter more, one less
        q, p = q[close], p[close]
        if width >= WIDTH:  # verifying long words costs more than comparing their vectors
            close = np.abs(q_vec[q] - vec[p]).sum(1, dtype=np.int16) <= 2
            q, p = q[close], p[close]
        for change in (-1, 0, 1):
            own = np.flatnonzero(size[p] - q_size[q] == change)
            i, j = q[own], p[own]
            if width < WIDTH:
                hit = one_edits(q_codes[i], codes[j], change)
            else:  # words too long to lie side by side
                hit = np.array([one_edit(asked[x], texts[y]) for x, y in zip(i.tolist(), j.tolist())], bool)
            np.add.at(near, i[hit], 1)
            np.minimum.at(best, i[hit], j[hit])
    found = np.flatnonzero(near).tolist()
    return pa.table([[asked[i] for i in found], near[found], [points[best[i]][0] for i in found],
                     [points[best[i]][1] for i in found]], schema=_NEAR)


def near_words(words: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``words(word, n)``, distinct words -> ``(word, n_near, best_n, best)`` for the words that have a
    near one; ``best`` is the near word of largest ``n`` (ties: the smallest by code points)."""
    tasks = shuffle_partitions(words.sparkSession)
    points = words.select("word", "n", F.length("word").alias("tree"), F.lit(1).cast("long").alias("node"))
    free, shut = F.lit(_NONE), F.lit(_SHUT)
    kinds = F.array(*[F.struct((F.length("word") + d).alias("tree"), m.alias("more"), s.alias("less"))
                      for d, m, s in ((-1, shut, free), (0, free, free), (1, free, shut))])
    searches = words.withColumn("k", F.explode(kinds)).select(
        "word", "k.tree", F.lit(1).cast("long").alias("node"), "k.more", "k.less")
    searches = searches.join(points.select("tree").distinct(), "tree", "left_semi")
    while True:
        splits = staged(_splits(points, cell), "splits")
        if splits.isEmpty():
            break
        points = staged(_moved(points, splits), "points")
        searches = staged(_searched(searches, splits), "searches")
    # a cell beyond the bound holds equal vectors only: it is dealt by word; so are the searches of a cell
    sizes = points.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts"))
    asked = searches.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cells = staged(sizes.join(asked, ["tree", "node"]), "cells")

    def dealt(df: DataFrame, own_: str, by: str, other: str, others: str) -> DataFrame:
        return (df.join(cells, ["tree", "node"])
                .withColumn(own_, F.pmod(F.xxhash64("word", F.lit(13)), F.col(by)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))))

    keys = ["tree", "node", "part", "block"]
    p = dealt(points, "part", "parts", "block", "blocks").select(*keys, "word", "n").repartition(tasks, *keys)
    of = [f"q_{k}" for k in keys]
    q = dealt(searches, "block", "blocks", "part", "parts").select(
        *[F.col(k).alias(o) for k, o in zip(keys, of)], F.col("word").alias("asked"), F.col("more").alias("gain"),
        F.col("less").alias("loss")).repartition(tasks, *of)
    found = p.groupBy(*keys).cogroup(q.groupBy(*of)).applyInArrow(
        lambda points, searches: _cell_search(points, searches), "word string, n_near long, best_n long, best string")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")))


def variants(words: DataFrame, ratio: int = RATIO, **kw) -> DataFrame:
    """``words(word, n)`` -> one row ``(word, form, root, n, n_near, form_n)`` per word.

    ``form`` is the near word of largest ``n`` if that is at least ``ratio`` times
    the word's own, else null; ``root`` follows forms to the last. An empty table gives no row.
    """
    words = staged(words, "words")
    near = near_words(words, **kw)
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    # a form occurs ratio times as often as its word, so a chain has under log(largest n) links; each
    # round doubles the length followed
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    largest = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log(max(largest, 2), max(ratio, 2)) + 1))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return rows.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **kw) -> DataFrame:
    """``variants`` of all words of ``docs(doc_id, text)``.

    A null text has no word, a null id counts as an empty one; repeated rows
    count as often as they occur. Further columns are ignored.
    """
    return variants(word_counts(docs), **kw)


#: DuckDB SQL of the query: CRC-32 by start value, reflected polynomial and eight shifts a byte;
#: near words by the words that one deletion leaves; roots by following forms.
SQL = """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run
  FROM documents
), each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY id, run),
steps AS (
  SELECT i AS byte, list_reduce([i::UBIGINT] || [0::UBIGINT FOR j IN range(8)],
    lambda c, j: xor(c >> 1, (c & 1) * 3988292384)) AS step FROM range(256) t(i)
), crc AS (
  SELECT id, run, hex(encode(id || ':' || run)) AS bytes, 0 AS pos, 4294967295::UBIGINT AS c FROM each
  UNION ALL
  SELECT id, run, bytes, pos + 1, xor(c >> 8, step) FROM crc
  JOIN steps ON byte = xor(c & 255, ('0x' || bytes[2 * pos + 1:2 * pos + 2])::UBIGINT) WHERE 2 * pos < length(bytes)
), hashed AS (
  SELECT id, run, xor(c, 4294967295) AS h FROM crc WHERE 2 * pos = length(bytes)
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
    sum(n)::BIGINT AS n
  FROM each JOIN hashed USING (id, run) GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), cut AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), near AS (
  SELECT word, count(*) AS n_near, arg_min(other, {'m': -other_n, 'w': other}) AS best, max(other_n) AS best_n
  FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
    CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), follow AS (
  SELECT word, word AS last, form AS next FROM forms
  UNION ALL
  SELECT f.word, f.next, g.form FROM follow f JOIN forms g ON g.word = f.next
)
SELECT f.word, f.form, r.last AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN follow r ON r.word = f.word AND r.next IS NULL
"""
