"""Exact copies, importance resampling and collocations against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from tapeloom.llm import collocations as phrases  # noqa: E402
from tapeloom.llm import exact_copies as copies  # noqa: E402
from tapeloom.llm import importance, words  # noqa: E402
from tapeloom.llm.base import utf8  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, key long, size long, rank long, n long, words string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, g, 7, 8, 9, 10, "x") for i, t, g in rows], SCHEMA).repartition(parts)


def thue_morse() -> tuple[str, str]:
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_word_hashes_do_not_collide_by_structure():
    rng = random.Random(5)
    some = {"".join(rng.choices("ab", k=rng.choice([1, 7, 8, 9, 16, 17, 256, 257]))) for _ in range(20_000)}
    some = sorted(some | set(thue_morse()))
    data, offsets = utf8(pa.array([" ".join(some)]))
    found = words.find_words(data, offsets, words.ALNUM)
    for seed in (0, 1):
        assert len(np.unique(words.hash_words(data, found, seed))) == len(some)
    assert not (words.hash_words(data, found, 0) == words.hash_words(data, found, 1)).any()


# ---- exact copies -------------------------------------------------------------------------------------------

COPIES = [
    (1, "a b"), (2, "ab"), (3, "a\tb \n"), (None, "a    b"), (5, "a b"), (6, None), (7, ""), (8, " \x0b\x0c\r"),
    (9, "x" * 5000), (10, "x" * 5000), (11, "x " * 5000), (10, "x" * 5000), (None, "only"), (12, "A b"), (13, "é é"),
    (14, "éé"), (None, "null twice"), (None, "null  twice"),
]


def plain_copies(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        taken = False
        for m in members:
            kept = m == best and not taken
            taken |= kept
            out.append((m[3], best[3], len(members), kept, plain.sha(body)))
    return sorted(out, key=str)


def got_copies(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("key_bits,capacity", [(64, copies.CAPACITY), (64, 8), (2, 8), (1, 1 << 20)])
def test_copies_equal_plain_python(spark, key_bits, capacity):
    docs = frame(spark, [(i, t, "en") for i, t in COPIES])
    assert got_copies(copies.exact_copies(docs, capacity=capacity, key_bits=key_bits)) == plain_copies(COPIES)


def test_hot_copies_and_flushes(spark, monkeypatch):
    rows = [(i, "the same text", "en") for i in range(600)] + [(i, f"own {i}", "en") for i in range(600, 900)]
    docs = frame(spark, rows, 5)
    assert got_copies(copies.exact_copies(docs, capacity=64)) == plain_copies([r[:2] for r in rows])


def test_directory_doubles_only_where_it_must(spark):
    # two full keys alike in three leading bits, a small one, and one too full for any bucket
    keys = [0b0000 << 60, 0b0001 << 60, 0b0100 << 60, (0b1111 << 60) - (1 << 64)]
    rows = [(keys[0], 10)] * 5 + [(keys[1], 10)] * 5 + [(keys[2], 10)] + [(keys[3], 10)] * 10
    buckets, depth = copies.grow_directory(spark.createDataFrame(rows, "key long, size long"), capacity=60)
    assert (buckets, depth) == ([(0, 4), (1, 4), (1, 2), (3, 2)], 4)
    slots = copies.directory_slots(buckets, depth)
    assert slots["slot"].is_unique
    place = dict(zip(slots["slot"], slots["bucket"]))
    assert len({place[(k >> 60) & 15] for k in keys}) == 4


def test_copies_of_nothing(spark):
    empty = frame(spark, [(1, "a", "en")]).limit(0)
    assert copies.exact_copies(empty).collect() == []


# ---- importance resampling ----------------------------------------------------------------------------------


def test_crcs_of_runs_equal_zlib(monkeypatch):
    rng = random.Random(1)
    texts = ["", "ab  cd.ef", "É straße x", "a" * 5000 + " b " + "c" * 600] + [
        " ".join("".join(rng.choices("abcdé", k=rng.choice([1, 3, 7, 600]))) for _ in range(rng.randint(0, 60)))
        for _ in range(30)]
    data, offsets = utf8(pa.array(texts, pa.string()))
    lower = words.LOWER[data]
    found = words.find_words(lower, offsets, words.ALNUM)
    own = [bytes(lower[a:b]) for a, b in zip(found.starts, found.ends)]
    for stretch in (1 << 20, 3000, 10):
        monkeypatch.setattr(importance, "STRETCH", stretch)
        for size, got in enumerate(importance.run_crcs(lower, found, 3), 1):
            assert got.tolist() == [zlib.crc32(b" ".join(own[i:i + size])) for i in range(len(own) - size + 1)]


def plain_importance(rows, target, longest, buckets, seed, least, percent):
    def features(text):
        own = [x.encode() for x in plain.words(text or "")]
        return [zlib.crc32(b" ".join(own[i:i + n])) % buckets for n in range(1, longest + 1)
                for i in range(len(own) - n + 1)]

    s = collections.Counter(b for _, t in rows for b in features(t))
    t = collections.Counter(b for text in target for b in features(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
            for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        own = features(text)
        weight = sum(gain[b] for b in own)
        head = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8]
        score = weight + math.floor(-1000 * math.log(-math.log((int(head, 16) + 0.5) / 2 ** 32)))
        out.append([doc_id, len(own), weight, score, None, len(plain.words(text or "")) >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))
    for rank, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance_equals_plain_python(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "straße", "Ⅷ"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(80)]
    # rows alike in everything: their ranks are neighbours, in either order
    rows += [(None, rows[3][1]), (None, None), (200, None), (201, ""), (rows[5][0], rows[5][1]), (202, "One" * 9000)]
    target = [" ".join(rng.choices(vocabulary[:10], k=30)) for _ in range(5)] + [None, ""]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, score long")
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    for longest, percent in ((1, 10), (3, 90)):
        got = importance.importance_sample(docs, bench, longest=longest, buckets=97, percent=percent)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_importance(
            rows, target, longest, 97, 2024, 20, percent)


def test_importance_of_nothing(spark):
    docs = frame(spark, [(1, "a " * 30, "en")])
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert importance.importance_sample(docs.limit(0), bench).collect() == []
    one = importance.importance_sample(docs, bench.limit(0), percent=100).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in one] == [(1, 30, 1)]


# ---- collocations -------------------------------------------------------------------------------------------


def plain_phrases(rows, support):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(plain.ASCII_LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for size in range(1, 5):
                f.update((lang, tuple(own[i:i + size])) for i in range(len(own) - size + 1))
    frequent = {k: v for k, v in f.items() if v >= support}
    around = collections.Counter()
    for (lang, p), v in frequent.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                around[lang, p[i:i + size]] = max(around[lang, p[i:i + size]], v)
    kept = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) > 1 and 100 * around[lang, p] < 80 * a:
            score, _, left, right = min(
                (2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                for k in range(1, len(p)))
            kept[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in kept.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found), 1))


def phrase_rows() -> list[tuple[str | None, str | None]]:
    rng = random.Random(11)
    common = ["of", "the", "new", "york", "times", "É", "straße", "a"]
    rows: list[tuple[str | None, str | None]] = []
    for i in range(120):
        text = " ".join(rng.choices(common, k=rng.randint(0, 25)))
        text += rng.choice([". New York Times", "; hot dog stand", "\nof  the\tNew York", " ab:cd ef gh ij", ""])
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + [("en", None), ("en", ""), ("en", "..;"), ("en", "of the new york times " * 40), ("xx", "lone words")]


@pytest.mark.parametrize("share,lowered", [(0.25, None), (0.02, 6), (1.0, 30)])
def test_collocations_equal_plain_python(spark, monkeypatch, share, lowered):
    """A small sample with a high bar misses much, so that failures make further passes."""
    rows = phrase_rows()
    docs = frame(spark, [(i, t, g) for i, (g, t) in enumerate(rows)])
    got = phrases.collocations(docs, support=12, share=share, lowered=lowered)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 12)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
    text = "one two three. four five six; seven eight\nnine ten " * 6
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["en"])], names=["text", "lang"])
    whole = plain_phrases([("en", text)], 1)
    held = collections.Counter()
    for stretch, _ in phrases.stretches(iter([batch])):
        at = np.flatnonzero(stretch.piece[:-1] == stretch.piece[1:])
        held.update(stretch.phrase(int(i), 2).decode() for i in at)
    want = collections.Counter()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
        own = piece.split()
        want.update(" ".join(p) for p in zip(own, own[1:]))
    assert held == want and whole


def test_collocations_of_nothing(spark):
    assert phrases.collocations(frame(spark, [(1, "a", "en")]).limit(0)).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None)])).collect() == []


def test_words_alike_in_structure_link_nothing(spark):
    from tapeloom.llm.jaccard import similarity_components

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(thue_morse(), 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similarity_components(docs).collect()}
    assert got == {1: 1, 2: 2}
