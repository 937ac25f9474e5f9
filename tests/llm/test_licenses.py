"""License scan against a plain matcher on made texts (the SQL covers the tables)."""

import re

from donorlens.llm import licenses


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def test_base_columns_and_method_labels(spark):
    texts = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0. CC BY cc-by; CC\nBY",
             "mit licensed", "the gnu lesser general public license", "ÀMIT License ÀMIT", "MIT" + "\x7f" + "LICENSE",
             "Redistribution and use in source and binary forms, with or without modification, are permitted", None, "",
             "license " * 50, "gnu general public license " * 3, "Permission is hereby granted, free of charge"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    label = {i: rows[i]["labels"].split(",") for i in rows}
    assert "mit" in label[0] and rows[0]["score"] == 1
    assert {"gpl", "gpl-3.0"} <= set(label[1]) and "gpl-2.0" not in label[1]
    assert {"cc-by", "cc-by-nc"} <= set(label[2])
    assert {"apache", "apache-2.0", "cc-by"} <= set(label[3])
    assert label[4] == [""] and "lgpl" in label[5] and "bsd" in label[8]


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["labels"] == "" and r["score"] == 0 for r in rows)
    assert licenses.scan(no_docs).count() == 0
