"""The pipeline's stages against plain versions of what each decides on its own input."""

import corpus_pipeline as P
from donorlens.llm import mixing, simhash, toxicity
from donorlens.llm.common import documents, staged


def test_each_stage_on_its_own_input(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = staged(stage(spark, docs, sf), f"test{k}")
        if k < len(P.STAGES) - 1:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen[name] = (docs, out)
        docs = out
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.classify(before, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
    before, after = seen["simhash near-dedup"]
    groups = simhash.near_duplicates(before).collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["component_id"] for r in groups})
    before, after = seen["pii surrogates"]
    old, new = ({r["doc_id"]: r for r in f.collect()} for f in (before, after))
    assert old.keys() == new.keys()
    assert not any("@mail" in (r["text"] or "") for r in new.values())
    same = [i for i in old if old[i] == new[i]]
    assert len(same) > 0.85 * len(old)
    before, after = seen["mixing"]
    want = [r["doc_id"] for r in mixing.mixture(before).select("row.doc_id", "copies").collect()
            for _ in range(r["copies"])]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
    before, after = seen["best-fit packing"]
    pieces = after.collect()
    assert sum(r["piece"] == 0 for r in pieces) == before.count()


def test_run_and_odd_rows(spark, sf, odd_docs, no_docs):
    assert P.run(spark, sf).count() > 0
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(P.STAGES):
            docs = staged(stage(spark, docs, sf), f"odd{k}")
            if k < len(P.STAGES) - 1:
                assert docs.columns == odd_docs.columns
        docs.count()


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash near-dedup", "pii surrogates", "mixing", "best-fit packing"]
    assert P.ORACLE_SQL is None


def test_registration():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(isinstance(sql, str) for sql in E.oracle_sql().values())
