"""License detection with a positional rare-token index, in DataFrame expressions only.

A template is a licence statement as a word sequence with mandatory key phrases.
Words are weighted by inverse document frequency over all documents. The index
lists each template under its rarest mandatory word (highest IDF): every accepted
place contains that word, so looking up a file's rarest licence words finds all
places. An occurrence at file position p of the word at template position q
means that the template would start at p - q; there the other template words
are intersected with the file by relative position. A place is accepted if all
key phrases stand there word for word and the words found carry at least
``MIN_SHARE`` of the template's IDF weight, so optional words may differ.

Two passes over the texts and no shuffle of them: one counts document
frequencies of the templates' vocabulary (some hundred words reach the driver),
one matches each row by itself.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import ascii_lower

MIN_SHARE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, statement, mandatory key phrases.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]

_SCHEMA = ("array<struct<label:string,base:boolean,words:array<string>,idf:array<double>,total:double,"
           "must:array<int>,anchor:string,at:int>>")


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased (null: none)."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS, -1), lambda w: w != "")


def _library() -> list[dict]:
    out = []
    for phrase, label in BASE.items():
        w = phrase.split()
        out.append({"label": label, "base": True, "words": w, "must": list(range(len(w)))})
    for label, statement, phrases in TEMPLATES:
        w, must = statement.split(), set()
        for phrase in phrases:
            p = phrase.split()
            at = next(i for i in range(len(w)) if w[i:i + len(p)] == p)
            must |= set(range(at, at + len(p)))
        out.append({"label": label, "base": False, "words": w, "must": sorted(must)})
    return out


def build_index(docs: DataFrame, text_col: str = "text") -> list[dict]:
    """The template library with IDF weights over all rows and each template's rarest mandatory word."""
    library = _library()
    vocabulary = sorted({w for t in library for w in t["words"]})
    known = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(known, words_of(F.col(text_col)))))
                       .alias("w"))
    df = {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}  # a row per licence word; "" counts rows
    n = df.get("", 0)
    for t in library:
        t["idf"] = [math.log(1 + n / (1 + df.get(w, 0))) for w in t["words"]]
        t["total"] = sum(t["idf"])
        t["at"] = min(t["must"], key=lambda i: (-t["idf"][i], t["words"][i], i))
        t["anchor"] = t["words"][t["at"]]
    return library


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row.

    ``score`` is the largest matched weight share of a template other than the
    base phrases, 0 without any. A null or empty text has no words and no
    label; null ids and repeated rows give their own rows; other columns are
    ignored.
    """
    index = build_index(docs, text_col)
    anchors = sorted({t["anchor"] for t in index})
    library = F.from_json(F.lit(json.dumps(index)), _SCHEMA)
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    spots = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                     lambda x: x["w"].isin(anchors))
    rows = rows.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), spots.alias("spots"))

    def places(t: Column) -> Column:
        starts = F.transform(F.filter("spots", lambda x: x["w"] == t["anchor"]), lambda x: x["i"] - t["at"])
        held = F.transform(starts, lambda s: F.struct(
            s.alias("start"),
            F.forall(t["must"], lambda o: F.coalesce(F.get("w", s + o) == F.get(t["words"], o), F.lit(False)))
            .alias("whole"),
            (F.aggregate(F.zip_with(t["words"], t["idf"], lambda w, f: F.struct(w.alias("w"), f.alias("f"))),
                         F.struct(s.alias("at"), F.lit(0.0).alias("sum")),
                         lambda a, x: F.struct((a["at"] + 1).alias("at"), (a["sum"] + F.when(
                             F.get("w", a["at"]) == x["w"], x["f"]).otherwise(0.0)).alias("sum")))["sum"]
             / t["total"]).alias("share")))
        return F.filter(held, lambda p: p["whole"] & (p["share"] >= MIN_SHARE))

    found = F.filter(F.transform("lib", lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"),
                                                           places(t).alias("places"))),
                     lambda x: F.size(x["places"]) > 0)
    none = F.array().cast("array<struct<label:string,base:boolean,places:array<struct<start:int,whole:boolean,"
                          "share:double>>>>")
    rows = rows.withColumn("lib", library).select(
        "doc_id", "n_words", F.when(F.size("spots") > 0, found).otherwise(none).alias("found"))
    base = F.filter("found", lambda x: x["base"])
    starts = F.flatten(F.transform(base, lambda x: F.transform(x["places"], lambda p: p["start"])))
    shares = F.flatten(F.transform(F.filter("found", lambda x: ~x["base"]),
                                   lambda x: F.transform(x["places"], lambda p: p["share"])))

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")

    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.array_max(shares), F.lit(0.0)), 6).alias("score"))


def _sql_list(values: list) -> str:
    return "[" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def oracle_sql() -> str:
    """The same result in DuckDB SQL, by trying every start of every template."""
    lib = ",\n    ".join(f"({k}, '{t['label']}', {str(t['base']).lower()}, {_sql_list(t['words'])}, "
                        f"{_sql_list(t['must'])})" for k, t in enumerate(_library()))
    return f"""
WITH lib(k, label, base, words, must) AS (VALUES
    {lib}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), vocab AS (SELECT DISTINCT unnest(words) AS word FROM lib),
pos AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
vpos AS (SELECT pos.* FROM pos JOIN vocab USING (word)),
idf AS (
  SELECT word, ln(1 + (SELECT count(*) FROM d) / (1 + count(DISTINCT r))) AS idf
  FROM vocab LEFT JOIN vpos USING (word) GROUP BY word
), tw AS (SELECT k, unnest(words) AS word, unnest(range(len(words))) AS q FROM lib),
weights AS (SELECT k, sum(idf) AS total FROM tw JOIN idf USING (word) GROUP BY k),
hit AS (
  SELECT k, r, p - q AS start, sum(idf) AS got, count(CASE WHEN list_contains(must, q) THEN 1 END) AS n_must
  FROM vpos JOIN tw USING (word) JOIN idf USING (word) JOIN lib USING (k) GROUP BY k, r, p - q
), place AS (
  SELECT hit.*, label, base, got / total AS share FROM hit JOIN lib USING (k) JOIN weights USING (k)
  WHERE n_must = len(must) AND got / total >= {MIN_SHARE}
), per AS (
  SELECT r, count(CASE WHEN base THEN 1 END) AS n_base, min(CASE WHEN base THEN start END) AS first_word,
    max(CASE WHEN base THEN start END) AS last_word,
    string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN NOT base THEN share END) AS score
  FROM place GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN per USING (r)
"""
