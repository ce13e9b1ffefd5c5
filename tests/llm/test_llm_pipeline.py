"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402


def test_stages_follow_their_contracts(spark, tmp_path):
    import corpus_pipeline as p
    from tapeloom.llm.base import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    kept = {}
    for name, stage in p.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        was = {r["doc_id"]: r for r in before.collect()}
        if name != "tokens":
            assert docs.columns == list(p.COLUMNS)
        if name == "near_duplicates":
            rows = [(i, r["text"]) for i, r in was.items()]
            assert set(kept[name]) == {i for (i, _), c in zip(rows, plain.link_components(rows)) if i == c}
        elif name == "decontamination":
            assert set(kept[name]) == {i for i, r in was.items() if not plain.leaks(r["text"], items)}
        elif name == "secrets":
            assert set(kept[name]) == set(was)
            assert not any(plain.secrets(r["text"]) for r in kept[name].values())
            assert all(r["text"] == was[i]["text"] for i, r in kept[name].items() if not plain.secrets(was[i]["text"]))
            assert all(r["n_chars"] == len(r["text"]) for r in kept[name].values())
    good = {r["doc_id"] for r in table(spark, sf, "labels").filter("quality = 1").collect()}
    assert good <= set(kept["quality"])
    assert set(kept["tokens"]) == set(kept["secrets"])


def test_repeated_and_unnamed_rows(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == [1, 3, 4, None]
    assert p.secret_scan(spark, docs, "").count() == 7 and p.tokens(spark, docs.limit(0), "").count() == 0
    assert p.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_rows_without_or_with_a_shared_id_are_judged_by_themselves(spark):
    import corpus_pipeline as p
    from tapeloom.llm.base import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select(*p.COLUMNS)
    item = table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    clean = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(None, item), (7, item), (7, clean), (None, clean + " x")],
                                 "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = sorted((tuple(r) for r in p.decontamination(spark, rows, sf).select("doc_id", "text").collect()), key=str)
    assert got == [(7, clean), (None, clean + " x")]
    # the same text under another id, or none, meets the same decision
    found = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in p.quality(spark, docs, sf).collect()}
    again = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars").unionByName(docs)
    twice = [r["text"] for r in p.quality(spark, again, sf).collect() if r["doc_id"] is None]
    bad = [r["text"] for i, r in found.items() if i not in kept]
    assert bad and len(twice) < len(found)
    assert sum(t in set(bad) for t in twice) <= 0.1 * len(bad)


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_nothing_else_imports_this_package():
    root = Path(__file__).resolve().parents[2]
    for path in [*root.glob("tapeloom/**/*.py"), root / "bench.py"]:
        if "/llm/" not in str(path):
            assert "tapeloom.llm" not in path.read_text(), path
