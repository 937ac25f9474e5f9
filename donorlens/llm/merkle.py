"""Merkle manifest of a dataset as a persistent, path-copying tree.

Leaves are SHA-256 digests of rows. The leaves of a group, in key order, are
joined two by two, level by level, to the group's subroot; the subroots, in
order of the groups, likewise to the root.

Storage. A tree is cut into aligned blocks of ``BLOCK`` nodes: leaves
``1024 b .. 1024 b + 1023`` hang below one node ten levels up, whatever else
the tree holds. A block is one row of a Parquet table, so a task works on whole
blocks and never on a whole group; the block roots are the nodes of the next,
1024 times smaller table. A block's inner nodes follow from its own row.

Versions. A changed leaf makes a new version of the tree: the ancestors of that
leaf are copied within its block, every other node is shared with the base. The
new block root continues as the change of one node in the table above, and so
on up to a new root. What a version needs of the tables above is the same for
all leaves of a block: the siblings on the way from the block to the root. They
are handed down once, from the root's block to the lowest ones, by joins on the
block number, so every version is finished where its leaf lies: no upper block
gathers the versions of all the leaves below it.

Every step is a range sort, an aggregate into rows of at most ``BLOCK`` nodes or
a join of unique keys; the number of steps grows with the logarithm of the rows
to the base 1024.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import global_rank, shuffle_partitions, staged

BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ALONE, _LEFT, _RIGHT = 0, 1, 2  # where a node's sibling stands: none, on its left, on its right


def joined(digests: list[bytes]) -> bytes:
    """The digest of a run of nodes, whose digests count as hex text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    framed = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def block_levels(nodes: list[bytes], total: int, bits: int = BLOCK_BITS) -> list[list[bytes]]:
    """All levels of one block, its nodes first, of a table of ``total`` nodes. A block
    that is the whole table ends at its root, others are ``bits`` levels high."""
    height = bits if total > 1 << bits else max(total - 1, 0).bit_length()
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([joined(below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def _siblings(levels: list[list[bytes]], i: int) -> bytes:
    """The way of node ``i`` to its block's root: per level the sibling's side, and its digest if there is one."""
    way = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            way += [bytes([_LEFT if i & 1 else _RIGHT]), level[i ^ 1]]
        else:
            way.append(bytes([_ALONE]))
        i >>= 1
    return b"".join(way)


def fold(leaf: bytes, way: bytes) -> tuple[list[bytes], list[bytes]]:
    """The ancestors of ``leaf``, up to the root, and the siblings met on the way."""
    up, siblings, at = [], [], 0
    while at < len(way):
        side, at = way[at], at + 1
        if side == _ALONE:
            leaf = joined([leaf])
        else:
            sibling, at = way[at:at + 32], at + 32
            siblings.append(sibling)
            leaf = joined([sibling, leaf] if side == _LEFT else [leaf, sibling])
        up.append(leaf)
    return up, siblings


def _block_roots(bits: int):
    @F.arrow_udf("binary")
    def root(nodes: pa.Array, total: pa.Array) -> pa.Array:
        return pa.array([block_levels(ns, t, bits)[-1][0] for ns, t in zip(nodes.to_pylist(), total.to_pylist())],
                        pa.binary())

    return root(F.col("nodes"), F.col("total"))


def _ways_down(bits: int):
    """For every node of a block its way to the root: within the block, then the block's own way."""
    @F.arrow_udf("array<binary>")
    def ways(nodes: pa.Array, total: pa.Array, above: pa.Array) -> pa.Array:
        out = []
        for ns, t, way in zip(nodes.to_pylist(), total.to_pylist(), above.to_pylist()):
            levels = block_levels(ns, t, bits)
            out.append([_siblings(levels, i) + way for i in range(len(ns))])
        return pa.array(out, pa.list_(pa.binary()))

    return ways(F.col("nodes"), F.col("total"), F.col("way"))


def _versions(bits: int):
    """Per leaf of a block: its proof's digest, the root of its version, and the ancestors copied for it."""
    kind = pa.list_(pa.struct([("proof", pa.binary()), ("version_root", pa.binary()), ("copied", pa.list_(pa.binary()))]))

    @F.arrow_udf("array<struct<proof:binary,version_root:binary,copied:array<binary>>>")
    def made(nodes: pa.Array, edits: pa.Array, total: pa.Array, above: pa.Array) -> pa.Array:
        out = []
        for ns, es, t, way in zip(nodes.to_pylist(), edits.to_pylist(), total.to_pylist(), above.to_pylist()):
            levels = block_levels(ns, t, bits)
            rows = []
            for i, (leaf, edit) in enumerate(zip(ns, es)):
                new = leaf if edit is None else edit
                up, siblings = fold(new, _siblings(levels, i) + way)
                rows.append({"proof": joined(siblings), "version_root": up[-1] if up else new,
                             "copied": up if edit is not None else None})
            out.append(rows)
        return pa.array(out, kind)

    return made(F.col("nodes"), F.col("edits"), F.col("total"), F.col("way"))


def _blocks(nodes: DataFrame, bits: int, name: str, carry: tuple = ()) -> DataFrame:
    """``nodes(tree, i, total, digest, *carry)`` -> one row per aligned block, dealt evenly over the tasks."""
    each = F.sort_array(F.collect_list(F.struct("i", "digest", *carry)))  # at most 2 ** bits nodes
    made = (nodes.withColumn("block", F.shiftright("i", bits)).repartition(shuffle_partitions(nodes.sparkSession), "tree", "block")
            .groupBy("tree", "block").agg(F.first("total").alias("total"), each.alias("each"))
            .select("tree", "block", "total", F.col("each.digest").alias("nodes"),
                    *[F.col(f"each.{c}").alias(f"{c}s") for c in carry]))
    return staged(made.withColumn("root", _block_roots(bits)), name)


def _grown(nodes: DataFrame, bits: int, name: str, carry: tuple = ()) -> list[DataFrame]:
    """The block tables of a forest, lowest first, up to one root per tree."""
    tables = [_blocks(nodes, bits, f"{name}0", carry)]
    while (tables[-1].agg(F.max("total")).first()[0] or 0) > 1 << bits:
        below = tables[-1]
        above = below.select("tree", F.col("block").alias("i"), F.shiftright(F.col("total") - 1, bits).alias("total"),
                             F.col("root").alias("digest")).withColumn("total", F.col("total") + 1)
        tables.append(_blocks(above, bits, f"{name}{len(tables)}"))
    return tables


@dataclass
class Manifest:
    """Block tables of a manifest, lowest first: ``groups`` (the leaves' trees) and ``top`` (the subroots' tree)."""

    groups: list[DataFrame]
    top: list[DataFrame]
    bits: int

    def _handed_down(self, tables: list[DataFrame], ways: DataFrame) -> DataFrame:
        """The lowest of ``tables`` with the way of each block to the root; ``ways`` has those of the highest's blocks."""
        for table in reversed(tables[1:]):
            held = table.join(ways, ["tree", "block"]).withColumn("each", _ways_down(self.bits))
            extra = [c for c in ways.columns if c not in ("tree", "block", "way")]
            ways = held.select("tree", *extra, F.posexplode("each").alias("at", "way"), "block").select(
                "tree", F.shiftleft("block", self.bits).alias("first"), "at", "way", *extra).select(
                "tree", (F.col("first") + F.col("at")).alias("block"), "way", *extra)
        return tables[0].join(ways, ["tree", "block"])

    def verified(self) -> DataFrame:
        """One row per leaf: ``(key, leaf, subroot, root, proof, version_root, copied)``, digests binary.

        ``version_root`` is the root of the leaf's version of the tree, that of an
        unchanged leaf folded from the leaf itself; ``copied`` holds the nodes
        that the version does not share with the base, lowest first (null without change).
        """
        start = self.top[-1].select("tree", "block", F.lit(b"").alias("way"), F.col("root").alias("whole"))
        top = self._handed_down(self.top, start).withColumn("each", _ways_down(self.bits))
        ways = top.select("whole", F.posexplode(F.arrays_zip("each", "nodes", "groups")).alias("at", "r")).select(
            F.col("r.groups").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("r.each").alias("way"),
            F.col("r.nodes").alias("subroot"), "whole")
        leaves = self._handed_down(self.groups, ways).withColumn("made", _versions(self.bits))
        return (leaves.select("subroot", "whole", F.explode(F.arrays_zip("keys", "nodes", "made")).alias("r"))
                .select(F.col("r.keys").alias("key"), F.col("r.nodes").alias("leaf"), "subroot",
                        F.col("whole").alias("root"), "r.made.*"))


def manifest(leaves: DataFrame, bits: int = BLOCK_BITS) -> Manifest:
    """``leaves(group, key, digest, edit)`` -> the tables of their manifest.

    ``digest`` and ``edit`` (the changed leaf, null: unchanged) are binary. Groups
    ascend null first, text by UTF-8 bytes; leaves ascend by key, null first, ties
    by digest. No row gives empty tables.
    """
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("edit")]
    ranked = global_rank(leaves.select("group", "key", "digest", "edit"), order)
    groups = global_rank(ranked.groupBy("group").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("total")),
                         [F.col("group").asc_nulls_first()], "tree")
    groups = staged(groups.withColumnRenamed("group", "g"), "groups")
    nodes = ranked.join(groups, F.col("group").eqNullSafe(F.col("g"))).select(
        "tree", (F.col("rank") - F.col("start")).alias("i"), "total", "digest", "key", "edit")
    tables = _grown(nodes, bits, "leaves", ("key", "edit"))
    count = groups.count()
    subroots = tables[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"),
                                 F.lit(count).cast("long").alias("total"), F.col("root").alias("digest"),
                                 F.col("tree").alias("group"))
    return Manifest(tables, _grown(subroots, bits, "top", ("group",)), bits)


def tampered_manifest(docs: DataFrame, tampered: Column, bits: int = BLOCK_BITS) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``, a tree per ``lang``; where
    ``tampered`` holds, a version of the tree has the row with one more in ``n_chars``.

    Nulls are allowed in all columns (a null ``n_chars`` stays null, and its
    version equals the base). Repeated rows are leaves of their own, one behind
    the other. Further columns are ignored; an empty table gives no row.
    """
    own = docs.select(*FIELDS)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    edit = F.when(F.coalesce(tampered, F.lit(False)),
                  row_digest([more if c == "n_chars" else F.col(c) for c in FIELDS]))
    leaves = own.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"),
                        row_digest([F.col(c) for c in FIELDS]).alias("digest"), edit.alias("edit"))
    return manifest(staged(leaves, "digests"), bits)


#: DuckDB SQL of the query: all levels of all trees, and a climb from every leaf. The numbers are
#: CRC-32's start value and reflected polynomial.
SQL = """
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    list_reduce([4294967295::UBIGINT] || [ord(x)::UBIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
      lambda crc, byte: list_reduce([xor(crc, byte)] || [0::UBIGINT FOR i IN range(8)],
        lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS crc,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text],
      lambda f: coalesce(strlen(f)::VARCHAR || ':' || f, '-')) AS f,
    coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') AS more
  FROM documents
), leaves AS (
  SELECT r, doc_id, lang, sha256(array_to_string(f, '')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(f[1] || f[2] || f[3] || more || f[5])
      ELSE sha256(array_to_string(f, '')) END AS changed FROM rows
), trees AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM leaves)),
placed AS (
  SELECT l.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang
), low AS (
  SELECT 0 AS level, tree, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT any_value(level) + 1, tree, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY tree, i // 2
), subroots AS (SELECT tree, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY i // 2
), climb AS (
  SELECT r, tree, 0 AS part, 0 AS level, i, changed AS h, '' AS siblings FROM placed
  UNION ALL
  SELECT c.r, c.tree, CASE WHEN a.n = 1 THEN 1 ELSE c.part END, CASE WHEN a.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN a.n = 1 THEN c.tree ELSE c.i // 2 END,
    CASE WHEN a.n = 1 THEN c.h WHEN c.i % 2 = 1 THEN sha256(s.h || c.h) ELSE sha256(c.h || coalesce(s.h, '')) END,
    c.siblings || CASE WHEN a.n = 1 THEN '' ELSE coalesce(s.h, '') END
  FROM climb c
  JOIN (SELECT 0 AS part, tree, level, i, n, h FROM low UNION ALL SELECT 1, NULL, level, i, n, h FROM high) a
    ON a.part = c.part AND (c.part = 1 OR a.tree = c.tree) AND a.level = c.level AND a.i = c.i
  LEFT JOIN (SELECT 0 AS part, tree, level, i, n, h FROM low UNION ALL SELECT 1, NULL, level, i, n, h FROM high) s
    ON s.part = c.part AND (c.part = 1 OR s.tree = c.tree) AND s.level = c.level AND s.i = xor(c.i, 1)
  WHERE NOT (c.part = 1 AND a.n = 1)
), top AS (SELECT h AS root, level AS height FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, top.root, sha256(c.siblings) AS proof_sha256, c.h AS folded_root,
  c.h = top.root AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN top
JOIN climb c ON c.r = p.r AND c.part = 1 AND c.level = top.height
"""
