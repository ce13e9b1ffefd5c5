"""What the Jaccard join moves: sets that only chance brings together, blocks of stragglers, shuffle files."""

from __future__ import annotations

import random
import sys
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402


@pytest.fixture
def written(monkeypatch):
    """Rows of the tables that a join writes, by label."""
    from tapeloom.llm import jaccard

    rows = Counter()

    def write(df, label, write=jaccard.written_once):
        out = write(df, label)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(jaccard, "written_once", write)
    return rows


def expected(rows):
    return sorted((i, len(plain.shingle_set(t)), c) for (i, t), c in zip(rows, plain.link_components(rows)))


def got(docs, **kw):
    from tapeloom.llm.jaccard import similarity_components

    return sorted(tuple(r) for r in similarity_components(docs, **kw).collect())


def test_sets_that_share_a_bit_with_many_are_no_candidates(spark, written):
    """Every text holds three of 40 passages, two thirds of it, as others do, and links with none."""
    pick = random.Random(5)
    passages = [" ".join(f"p{k}x{i}" for i in range(24)) for k in range(40)]
    rows = [(i, " ".join([" ".join(f"w{i}x{k}" for k in range(34)), *pick.sample(passages, 3)])) for i in range(120)]
    rows += [(i + 200, t + " end") for i, t in rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(docs) == expected(rows)
    assert got(docs, frequent_share=0.02) == expected(rows)
    assert written["members"] == 20  # 5 pairs, twice; all 250 before


def test_the_pipeline_takes_few_rows_for_near_duplicates(spark, written):
    """Of rows that share a bit with many, only a copy of two goes; the others are not gathered as sets."""
    import corpus_pipeline as p

    passages = [" ".join(f"p{k}x{i}" for i in range(24)) for k in range(12)]
    rows = [(i, " ".join([" ".join(f"w{i}x{k}" for k in range(20)), passages[i % 12], passages[(i + 5) % 12]])) for i in range(48)]
    rows += [(None, rows[7][1] + " end"), (60, rows[8][1] + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, "").collect())
    assert kept == list(range(48))
    assert written["members"] == 4  # 2 pairs; all 50 before


def test_stragglers_meet_the_others_in_blocks(spark, written):
    """Copies with so many edits that some link with few others or none."""
    pick, base, rows = random.Random(11), [f"b{i}" for i in range(60)], []
    for i in range(90):
        own = list(base)
        for _ in range(pick.choice([0, 1, 1, 2, 2, 3])):
            own[pick.randrange(60)] = f"e{i}x{pick.randrange(9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(rows)
    assert 1 < len({c for _, _, c in want}) < 60
    assert got(docs, leaf=4) == want
    assert written["met"] and written["straggler-links"]


def test_shuffle_files_go_when_an_action_ends(spark, tmp_path):
    from tapeloom.session import shuffles_dropped

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in found.apply(i).getName() for i in range(found.size()))

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key), files()
    with shuffles_dropped(spark):
        spark.range(10_000, numPartitions=4).groupBy(F.col("id") % 99).count().write.parquet(f"{tmp_path}/a")
        for _ in range(50):
            if files() <= before:
                break
            time.sleep(0.2)
        assert files() <= before
    assert spark.conf.get(key) == was
    assert spark.read.parquet(f"{tmp_path}/a").count() == 99
