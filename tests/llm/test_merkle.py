"""Merkle manifest: a plain tree in memory, the copied nodes of versions, odd rows."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from donorlens.llm import merkle
from donorlens.llm.common import documents


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    fields = [None if x is None else str(x) for x in (r["doc_id"], r["source"], r["lang"], n, r["text"])]
    return digest(*["-" if x is None else f"{len(x.encode())}:{x}" for x in fields])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, version root, copied nodes) of every row, without blocks."""
    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([x[2] for x in sorted(langs[g], key=lambda x: x[:3])]) for g in order]
    top = levels([t[-1][0] for t in trees])
    for k, g in enumerate(order):
        for i, (_, _, h, r) in enumerate(sorted(langs[g], key=lambda x: x[:3])):
            new = leaf(r, 1) if tampered(r["doc_id"]) else h
            siblings, copied = [], []
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    s = level[at ^ 1] if at ^ 1 < len(level) else None
                    siblings += [s] if s else []
                    new = digest(new) if s is None else digest(s, new) if at & 1 else digest(new, s)
                    copied.append(new)
                    at >>= 1
            yield (r["doc_id"], h, trees[k][-1][0], top[-1][0], digest(*siblings), new,
                   copied if tampered(r["doc_id"]) else None)


def built(docs, bits):
    key = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    for r in merkle.tampered_manifest(docs, key, bits).verified().collect():
        yield (r["key"], *(r[c].hex() for c in ("leaf", "subroot", "root", "proof", "version_root")),
               None if r["copied"] is None else [x.hex() for x in r["copied"]])


def test_blocks_of_every_height(spark, sf):
    docs = documents(spark, sf)
    want = sorted(map(repr, plain(docs.collect())))
    assert sum("None)" not in x for x in want) > 10
    for bits in (2, 10):
        assert sorted(map(repr, built(docs, bits))) == want


def test_odd_rows(odd_docs, no_docs):
    for bits in (1, 10):
        assert sorted(map(repr, built(odd_docs, bits))) == sorted(map(repr, plain(odd_docs.collect())))
    assert list(built(no_docs, 10)) == []
    one = odd_docs.filter("doc_id = 7")
    got = list(built(one, 10))
    assert sorted(map(repr, got)) == sorted(map(repr, plain(one.collect())))
    assert got[0][1] == got[0][2] == got[0][3]  # a lone leaf is its own root


def test_largest_count_can_be_tampered(spark):
    ids = [i for i in range(200) if tampered(i)][:1]
    docs = spark.createDataFrame([(ids[0], "a", "en", 2**63 - 1, "t"), (ids[0] + 1, "a", "en", None, "t")],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(repr, built(docs, 10))) == sorted(map(repr, plain(docs.collect())))


def test_copied_nodes_complete_a_version(spark, sf):
    """The base's nodes with a version's copies laid over them are again a valid tree."""
    docs = documents(spark, sf).filter("lang = 'en'")
    rows = docs.collect()
    base = levels([x[1] for x in sorted(plain(rows), key=lambda x: x[0])])
    place = {r: i for i, r in enumerate(sorted(x["doc_id"] for x in rows))}
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id, *_, copied in built(docs, 3):
        if copied is None:
            continue
        tree, at = [list(x) for x in base], place[doc_id]
        tree[0][at] = leaf(by_id[doc_id], 1)
        for k, node in enumerate(copied[:len(base) - 1]):
            at >>= 1
            tree[k + 1][at] = node
        assert tree == levels(tree[0])
