"""Texts shorter, longer or fuller than the operators' windows, against plain Python."""

from __future__ import annotations

import collections
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402


def fresh(seed: int, n: int) -> str:
    """Words that no other seed has."""
    return " ".join(f"w{seed}x{i}" for i in range(n))


def whole_leaks(text: str, items: list[tuple[int, str]]) -> dict[int, float]:
    """``plain.leaks``, and the similarity of the whole text to items that have more shingles than it."""
    own, out = plain.shingles(text), plain.leaks(text, items)
    for item, item_text in items:
        target = plain.shingles(item_text)
        if len(own) < len(target):
            common = sum((collections.Counter(own) & collections.Counter(target)).values())
            if common / (len(own) + len(target) - common) >= 0.75:
                out[item] = common / (len(own) + len(target) - common)
    return out


def test_texts_shorter_than_an_item(spark):
    from tapeloom.llm.decontaminate import contaminated

    item = fresh(1, 39)
    items = [(1, item), (2, item + " " + fresh(2, 3)), (3, fresh(3, 8)), (4, "a b a b a b a b a b a b"), (5, "one two three"),
             (6, fresh(4, 30) + " " + item)]
    words = item.split()
    texts = [" ".join(words[:n]) for n in range(0, 40)] + [" ".join(words[n:]) for n in range(1, 14)]
    texts += [" ".join([*words[:15], "other", *words[16:36]]), fresh(3, 7), fresh(3, 6), fresh(3, 4), "a b a b a b a b a b",
              "a b a b a b a", "one two", "b a b a b a b a b a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: {k: round(v, 9) for k, v in whole_leaks(t, items).items()} for i, t in enumerate(texts)}
    assert want[36] == {1: round(32 / 35, 9), 2: round(32 / 38, 9)} and not plain.leaks(texts[36], items)
    for block_bytes in (1 << 20, 100):
        got = {r["doc_id"]: r for r in contaminated(docs, benchmark, block_bytes=block_bytes).collect()}
        assert {i: r["item_ids"] for i, r in got.items()} == {i: sorted(w) for i, w in want.items()}
        assert {i: round(r["similarity"], 9) for i, r in got.items()} == {i: max(w.values(), default=0.0) for i, w in want.items()}
        assert all(r["contaminated"] == bool(want[i]) for i, r in got.items())


def test_pipeline_drops_a_truncated_item(spark, tmp_path):
    import corpus_pipeline as p

    item = fresh(1, 39).split()
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join(item[:36]), "en", "x", 1), (2, " ".join(item[:20]), "en", "x", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in p.decontamination(spark, docs, str(tmp_path)).collect()] == [2]


def test_every_notice_of_a_text_is_found(spark):
    """All templates in one text, and one notice among all template words scattered in another."""
    from tapeloom.llm.licences import TEMPLATES, scan_licences

    labels = {t.label for t in TEMPLATES}
    notices = " ".join(f"{fresh(i, 20)} {t.text}" for i, t in enumerate(TEMPLATES))
    scattered = " ".join(f"s{i} {x}" for i, x in enumerate(sorted({x for t in TEMPLATES for x in t.text.split()})))
    apache = next(t for t in TEMPLATES if t.label == "apache-2.0")
    # the commoner a notice, the less rare its words
    rows = [(1, notices), (2, f"{scattered} {apache.text} {scattered}"), (3, scattered)]
    rows += [(10 + i, f"{apache.text} {fresh(i, 9)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in scan_licences(docs).collect()}
    assert labels <= set(got[1]["labels"].split(",")) and round(got[1]["score"], 9) == 1
    assert got[2]["labels"] == "apache,apache-2.0" and round(got[2]["score"], 9) == 1
    assert got[3]["labels"] == "" and got[3]["score"] == 0


def test_long_parts_are_linked_by_the_gap_between_them(spark):
    from tapeloom.llm import credentials as c

    bare = "Zm9vYmFyQmF6UXV4MTIzNDU2" * 30
    rows = [
        (1, f"{bare}\nclient_id: svc.reader"), (2, f"client_id: svc.reader\n{bare}"),
        (3, f"https://api.example.org/v1?q={'x' * 700}\npassword = correcthorse9"),
        (4, f"{bare}{' ' * 256}client_id: svc.reader"), (5, f"{bare}{' ' * 257}client_id: svc.reader"),
        (6, f"client_id: svc.reader{' ' * 256}{bare}"), (7, f"client_id: svc.reader{' ' * 257}{bare}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: {s["kind"] for s in r["spans"] or []} for r in c.find_secrets(docs).collect()}
    both = {"identifier", "bare"}
    assert spans == {1: both, 2: both, 3: {"endpoint", "assign"}, 4: both, 5: set(), 6: both, 7: set()}
    left = {r["doc_id"]: r["text"] for r in c.mask_secrets(docs).collect()}
    assert left[1] == left[2] == "[SECRET]\n[SECRET]" and left[5] == rows[4][1]

    # against all pairs
    pick, parts = random.Random(5), []
    for key in range(40):
        for _ in range(pick.randrange(2, 12)):
            start = pick.randrange(6000)
            parts.append((str(key), pick.choice(c.KINDS), start, start + pick.choice([20, 24, 90, 256, 300, 512, 1500])))
    parts = sorted(set(parts))
    want = {p for p in parts for o in parts if p[0] == o[0] and o[1] in c.NEEDS.get(p[1], ())
            and (0 <= p[2] - o[3] <= c.SCOPE or 0 <= o[2] - p[3] <= c.SCOPE)}
    found = spark.createDataFrame(parts, "key string, kind string, start long, end long")
    assert sorted(tuple(r) for r in c.linked(found).collect()) == sorted(want) and want


LONG = ["ann (at) mails.example.com", "alexandra.konstantinidou (at) physics.example.edu",
        "ann [at] mathematics.university.example.edu", "maria.magdalena.papadopoulou(at)example.org",
        "eleonora.vanderbilt-hohenstein (at) department-of-mathematics.university.example.edu"]


def test_stretches_hold_whole_addresses():
    from tapeloom.llm.personal import ROOM, stretches

    for own in LONG:
        text = f"{'word ' * 12}{own} {'word ' * 12}"
        at = text.index(own)
        assert stretches(text) == [(at - ROOM, at + len(own) + ROOM)]
    # a far-reaching name joins all stretches it passes; long runs cost a step per character
    text = f"7 {'a' * 90} 8 {'b' * 90} (at) {'c' * 90}.d"
    assert stretches(text) == [(0, 21), (73, len(text))]
    assert stretches("1" + "a" * 100 + "@" + "b" * 100) == [(0, 202)]
    assert stretches("a" * 200_000 + "(at)" * 50_000) == [(0, 400_000)]


def test_addresses_of_any_length_come_out_whole():
    import numpy as np
    from tapeloom.llm.personal import KINDS, added_spans, base_spans, examples, padded
    from tapeloom.llm.sequence_model import Tagger, classes
    from test_llm_operators import prose

    pick = random.Random(8)
    texts = [f"{prose(i, 9)} {pick.choice(['ann', 'bob', 'cy'])}{i}@mail{i % 9}.example.com {prose(i + 500, 8)}" for i in range(80)]
    rows = [e for t in texts for e in examples(t)]
    codes = np.stack([padded(classes(r[1])) for r in rows])
    tags = np.zeros(codes.shape, int)
    for i, (kind, _, a, b) in enumerate(rows):
        tags[i, a:b] = 2 + 2 * KINDS.index(kind)
        tags[i, a] -= 1
    tagger = Tagger(KINDS).fit(codes, tags, epochs=6)
    for k, own in enumerate(LONG):
        text = f"{prose(900 + k, 9)} {own} {prose(950 + k, 8)}"
        assert not base_spans(text)
        assert [(kind, text[a:b]) for kind, a, b in added_spans({0: text}, {0: []}, tagger)[0]] == [("email", own)]
    assert added_spans({0: f"{prose(990, 9)} (at) {prose(991, 9)} [at] all (at) noon. {prose(992, 5)}"}, {0: []}, tagger) == {}


def test_recall_of_every_rewritten_form(spark):
    """Trained as the query trains, measured on rewritten spans of texts it has not seen."""
    from collections import Counter

    from tapeloom.llm.base import texts
    from tapeloom.llm.personal import added_spans, base_spans, rewritings, trained_tagger

    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = trained_tagger(texts(known, "doc_id", "text"))
    unseen = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(known.select("text"), "text", "left_anti")
    unseen = [r["text"] for r in unseen.filter("text IS NOT NULL").orderBy("doc_id").limit(9000).collect()]
    by_form: dict = {}
    for text in unseen:
        spans = base_spans(text)
        for kind, a, b in spans if len(spans) < 4 else []:
            for form, new in enumerate(rewritings(kind, text[a:b])):
                before = text[max(0, a - 200):a]
                lead = len("tel. ") if new.startswith("tel. ") else 0
                by_form.setdefault((kind, form), []).append(
                    (before + new + text[b:b + 200], (kind, len(before) + lead, len(before) + len(new))))
    pick = random.Random(5)
    cases = [(form, *case) for form, of in sorted(by_form.items()) for case in pick.sample(of, min(60, len(of)))]
    assert len(by_form) == 14 and len(cases) >= 14 * 40
    found = {i: text for i, (_, text, _) in enumerate(cases)}
    got = added_spans(found, {i: base_spans(t) for i, t in found.items()}, tagger)
    total = Counter(form for form, _, _ in cases)
    right = Counter(form for i, (form, _, want) in enumerate(cases) if want in got.get(i, []))
    assert {form: right[form] / n for form, n in total.items() if right[form] < 0.9 * n} == {}
    found = dict(enumerate(pick.sample(unseen, 1500)))
    wrong = added_spans(found, {i: base_spans(t) for i, t in found.items()}, tagger)
    assert len(wrong) <= 3
