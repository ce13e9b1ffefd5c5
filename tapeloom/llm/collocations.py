"""Phrase collocations by sampling first (Toivonen's method), exact for all phrases.

Phrases are runs of up to four words within a piece of text, counted per
language. What occurs often enough in everything is found so:

1. A sample of the documents proposes phrases, level by level, at a lowered
   support. Proposals are closed: parts of a proposed phrase are proposed.
2. One full pass counts the proposals and their negative border, that is every
   phrase whose two longest parts are both proposed, all words included.
3. A border phrase that turns out frequent is a failure of the sample. It joins
   the proposals, and a further pass counts what thereby became countable and
   was not counted yet. When a pass brings no failure short enough to grow, the
   set is closed: any frequent phrase has frequent parts, so none is missing.

Proposals reach the tasks as a Bloom filter of bounded size. A false positive
counts a phrase in vain and changes no result. Counted phrases are keyed by two
unrelated hashes of their words, 94 bits together, summed per task before the
shuffle. With its count a phrase keeps one of 256 groups of texts that has it, so
that a last pass spells each frequent phrase out in that group's texts alone.

Defined results: a null text is empty and adds nothing; a null language is
``und``; a language without a frequent phrase of two words has no rows; repeated
rows count as often as they stand there; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm import words as w
from tapeloom.llm.base import CHUNK_BYTES, chunks, query, table, utf8
from tapeloom.session import written_once

MOST_WORDS, SUPPORT = 4, 30
#: A candidate goes if a longer one around it has this percentage of its count.
COVERED = 80
#: Phrases reported per language; a score is twice this many times the share of shared occurrences.
REPORTED, SCALE = 2000, 1_000_000
#: The sample's share of all documents; its support lies this many deviations below the expected count.
SHARE, DEVIATIONS = 0.25, 1.5
#: Bits of the filter for a proposal, and of a filter at least and at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
#: A key's lowest bits tell the phrase's size; a filter is probed by the bits from these places on.
LOW, HIGH = 2, 34
#: Different phrases that a task holds before it hands its counts on; and that it remembers to have spelled out.
HELD, SPELLED = 1 << 20, 1 << 18

#: Groups of texts, and what marks a key as seen in each.
GROUP_BITS = 8
_GROUPS = w.mix(np.arange(1, (1 << GROUP_BITS) + 1, dtype=np.uint64))
_PLACES = np.random.default_rng(20240311).integers(1, 1 << 63, size=MOST_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_bytes = np.arange(256)
PIECE_END = np.isin(_bytes, [ord(c) for c in ".,;:!?"]) | ((_bytes >= 10) & (_bytes <= 13))
MEMBER = ~(PIECE_END | (_bytes == 32) | (_bytes == 9))


class Filter:
    """A Bloom filter of phrase keys with two probes, by the lower and the upper bits of a key."""

    def __init__(self, bits: int):
        self.cells = np.zeros(bits >> 6, np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return self.probe(keys >> np.uint64(LOW)) & self.probe(keys >> np.uint64(HIGH))

    def probe(self, place: np.ndarray) -> np.ndarray:
        place = place & np.uint64(len(self.cells) * 64 - 1)
        return (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def with_keys(self, keys: DataFrame) -> Filter:
        """This and the ``key`` of every row; one number per cell touched comes to the driver."""
        bits = len(self.cells) * 64
        places = F.array(F.shiftrightunsigned("key", LOW), F.shiftrightunsigned("key", HIGH))
        touched = keys.select(F.explode(places).alias("place")).select(
            F.col("place").bitwiseAND(F.lit(bits - 1)).alias("place")).groupBy(
            F.shiftright("place", 6).alias("cell")).agg(
            F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("mask")).toArrow()
        out = Filter(bits)
        out.cells = self.cells.copy()
        out.cells[touched["cell"].to_numpy()] |= touched["mask"].to_numpy().view(np.uint64)
        return out


def filter_for(keys: DataFrame) -> Filter:
    bits = 1 << max(keys.count() * BITS_EACH, 1).bit_length()
    return Filter(min(max(bits, LEAST_BITS), MOST_BITS)).with_keys(keys)


class Stretch:
    """Words of a stretch of text, hashed with their language, and the pieces they stand in."""

    def __init__(self, lower: np.ndarray, offsets: np.ndarray, languages: np.ndarray, groups: np.ndarray):
        self.lower = lower
        self.words = w.find_words(lower, offsets, MEMBER)
        n = np.diff(self.words.first)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.languages, self.group = languages, groups[self.doc]
        self.hashes = w.hash_words(lower, self.words) ^ languages[self.doc]
        piece = np.searchsorted(np.flatnonzero(PIECE_END[lower]), self.words.starts)
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.piece = np.cumsum(new)

    @cached_property
    def others(self) -> np.ndarray:
        return w.hash_words(self.lower, self.words, 1) ^ self.languages[self.doc]

    @staticmethod
    def run(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total += hashes[at + k] * _PLACES[k]
        return w.mix(total)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Keys of the phrases of ``size`` words that start at words ``at``."""
        return self.run(self.hashes, at, size) << np.uint64(LOW) | np.uint64(size - 1)

    def seconds(self, at: np.ndarray, size: int) -> np.ndarray:
        """Their second hashes, of 32 bits."""
        return self.run(self.others, at, size) >> np.uint64(32)

    def countable(self, known: Filter | None, upto: int, counted: Filter | None = None
                  ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per size: starts and keys of all words, and of phrases whose two longest parts are in ``known``.

        The third array marks those of which the same holds by ``counted``.
        """
        at = np.arange(len(self.doc))
        found = [(at, self.keys(at, 1), np.full(len(at), counted is not None))]
        for size in range(2, upto + 1):
            at, keys, old = found[-1]
            part, before = np.zeros((2, len(self.doc) + 1), bool)
            part[at[known.holds(keys)]] = True
            if counted is not None:
                before[at[old & counted.holds(keys)]] = True
            at = np.flatnonzero(part[:-1] & part[1:])
            at = at[at + size - 1 < len(self.doc)]
            at = at[self.piece[at] == self.piece[at + size - 1]]
            found.append((at, self.keys(at, size), before[at] & before[at + 1]))
        return found

    def phrase(self, at: int, size: int) -> bytes:
        starts, ends = self.words.starts, self.words.ends
        return b" ".join(self.lower[starts[i]:ends[i]].tobytes() for i in range(at, at + size))


def language_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stretch, list[str]]]:
    """The texts of all batches in bounded stretches; a long text is cut where a piece ends."""
    for batch in chunks(batches):
        data, offsets = utf8(batch.column("text"))
        lower = w.LOWER[data]
        names = batch.column("lang").to_pylist()
        keys = np.array([language_hash(x) for x in names], np.uint64)
        groups = np.array([crc32(data[a:b]) % len(_GROUPS) for a, b in zip(offsets, offsets[1:])], np.uint64)
        if batch.num_rows > 1 or len(lower) <= 2 * CHUNK_BYTES:
            yield Stretch(lower, offsets, keys, groups), names
            continue
        ends = np.flatnonzero(PIECE_END[lower])
        at = 0
        while at < len(lower):
            next_end = np.searchsorted(ends, at + CHUNK_BYTES)
            upto = int(ends[next_end]) + 1 if next_end < len(ends) else len(lower)
            yield Stretch(lower[at:upto], np.array([0, upto - at]), keys, groups), names
            at = upto


class Tally:
    """Counts by key and second hash, folded whenever many have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, seconds: np.ndarray, groups: np.ndarray) -> None:
        # the group below the second hash: the least of both is one of a text that has the phrase
        self.parts.append(self.fold(keys, seconds << np.uint64(GROUP_BITS) | groups, np.ones(len(keys), np.int64)))
        self.held += len(self.parts[-1][0])

    @staticmethod
    def fold(keys, marks, n):
        order = np.argsort(keys)
        keys, marks, n = keys[order], marks[order], n[order]
        new = np.ones(len(keys), bool)
        # where keys collide a phrase may come out more than once; sums do not mind
        new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] >> np.uint64(GROUP_BITS) != marks[:-1] >> np.uint64(GROUP_BITS))
        first = np.flatnonzero(new)
        if not len(first):
            return keys, marks, n
        return keys[first], np.minimum.reduceat(marks, first), np.add.reduceat(n, first)

    def drain(self, least: int = HELD) -> Iterator[pa.RecordBatch]:
        """Everything, once ``least`` different phrases are held."""
        if not self.parts or self.held < 2 * least:
            return
        keys, marks, n = self.fold(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.held = [], 0
        if len(keys) < least:
            self.parts, self.held = [(keys, marks, n)], len(keys)
            return
        for at in range(0, len(keys), 1 << 16):
            to = at + (1 << 16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at:to].view(np.int64)), pa.array(marks[at:to].view(np.int64)), pa.array(n[at:to])],
                names=["key", "mark", "n"])


def count_phrases(rows: DataFrame, known: Filter | None, counted: Filter | None = None,
                  sizes: range = range(1, MOST_WORDS + 1)) -> DataFrame:
    """``key, second, n, group`` of the phrases that ``known`` makes countable and ``counted`` did not."""
    context = rows.sparkSession.sparkContext
    shared, before = context.broadcast(known), context.broadcast(counted)

    def count(batches: Iterator[pa.RecordBatch]):
        tally = Tally()
        for stretch, _ in stretches(batches):
            found = stretch.countable(shared.value, sizes[-1], before.value)
            for size in sizes:
                at, keys, old = found[size - 1]
                if old.any():
                    at, keys = at[~old], keys[~old]
                if len(at):
                    tally.add(keys, stretch.seconds(at, size), stretch.group[at])
            yield from tally.drain()
        yield from tally.drain(0)

    # tasks have summed already: rows are dealt by key as they are, and summed there
    return rows.mapInArrow(count, "key long, mark long, n long").repartition("key").groupBy(
        "key", F.shiftright("mark", GROUP_BITS).alias("second")).agg(
        F.sum("n").alias("n"), F.min(F.col("mark").bitwiseAND(F.lit(len(_GROUPS) - 1))).alias("group"))


def spell(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``key, second, lang, phrase`` of frequent phrases, and ``lang, n`` with the empty phrase for all words."""
    context = rows.sparkSession.sparkContext
    marks = F.array(*[F.lit(x) for x in _GROUPS.view(np.int64).tolist()])
    marked = frequent.select(F.col("key").bitwiseXOR(F.element_at(marks, (F.col("group") + 1).cast("int"))).alias("key"))
    shared = context.broadcast((filter_for(frequent.select("key")), filter_for(marked)))

    def find(batches: Iterator[pa.RecordBatch]):
        (known, wanted), seen, out, total = shared.value, set(), [], {}
        for stretch, names in stretches(batches):
            for name, n in zip(names, np.diff(stretch.words.first).tolist()):
                total[name] = total.get(name, 0) + n
            for size, (at, keys, _) in enumerate(stretch.countable(known, MOST_WORDS), 1):
                some = wanted.holds(keys ^ _GROUPS[stretch.group[at]])
                at, keys = at[some], keys[some]
                for start, *key in zip(at.tolist(), keys.view(np.int64).tolist(), stretch.seconds(at, size).tolist()):
                    if tuple(key) not in seen:
                        seen.add(tuple(key))
                        out.append([*key, names[stretch.doc[start]], stretch.phrase(start, size), 0])
            if len(out) >= 1 << 15:
                yield phrase_batch(out)
                out = []
            if len(seen) > SPELLED:
                seen.clear()
        out += ([None, None, name, b"", n] for name, n in total.items())
        if out:
            yield phrase_batch(out)

    return rows.mapInArrow(find, "key long, second long, lang string, phrase string, n long")


def phrase_batch(entries: list[list]) -> pa.RecordBatch:
    keys, seconds, names, phrases, n = zip(*entries)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(seconds, pa.int64()), pa.array(names, pa.string()),
         pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
        names=["key", "second", "lang", "phrase", "n"])


def propose(sample: DataFrame, lowered: int) -> DataFrame:
    """Keys of all phrases with the lowered support in the sample, found level by level."""
    found = None
    for size in range(1, MOST_WORDS + 1):
        known = None if found is None else filter_for(found)
        level = written_once(count_phrases(sample, known, sizes=range(size, size + 1)).filter(
            F.col("n") >= lowered).select("key"), "phrases-proposed")
        found = level if found is None else found.unionByName(level)
    return found


def outside(counted: DataFrame, known: Filter) -> DataFrame:
    """Keys that are not proposed and short enough to be a part of longer phrases."""
    shared = counted.sparkSession.sparkContext.broadcast(known)

    def keep(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            size = (keys & np.uint64((1 << LOW) - 1)) + np.uint64(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[~shared.value.holds(keys) & (size < MOST_WORDS)].view(np.int64))], names=["key"])

    return counted.select("key").mapInArrow(keep, "key long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
                     share: float = SHARE, lowered: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of every phrase that occurs ``support`` times, and ``lang, n`` of every language.

    The results do not depend on ``share`` and ``lowered``; the number of passes does.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    # copies are drawn one by one
    draw = F.pmod(F.hash("text", F.monotonically_increasing_id()), F.lit(1 << 16))
    sample = written_once(rows.withColumn("draw", draw).filter(F.col("draw") < int(share * (1 << 16))).drop("draw"),
                          "phrases-sample")
    expected = support * share
    if lowered is None:
        lowered = max(1, math.floor(expected - DEVIATIONS * math.sqrt(expected)))
    known, counted, frequent = filter_for(propose(sample, lowered)), None, None
    while True:
        new = written_once(count_phrases(rows, known, counted).filter(F.col("n") >= support), "phrases-counted")
        frequent = new if frequent is None else frequent.unionByName(new)
        failures = written_once(outside(new, known), "phrases-failed")
        if failures.isEmpty():
            break
        known, counted = known.with_keys(failures), known
    spelled = written_once(spell(rows, frequent), "phrases-spelled")
    names = spelled.filter("key IS NOT NULL").dropDuplicates(["key", "second"]).select("key", "second", "lang", "phrase")
    totals = spelled.filter("key IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return frequent.join(names, ["key", "second"]).select("lang", "phrase", F.col("n").alias("f")), totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
                 share: float = SHARE, lowered: int | None = None, covered: int = COVERED,
                 reported: int | None = REPORTED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``; all candidates that stay if ``reported`` is null."""
    frequent, totals = frequent_phrases(docs, text_col, lang_col, support, share, lowered)
    frequent = written_once(frequent.withColumn("words", F.split("phrase", " ")), "phrases-frequent")
    candidates = frequent.filter(F.size("words") > 1)
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), "words",
        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")
    ).select(
        "lang", "phrase", "a", "cut", F.expr("concat_ws(' ', slice(words, 1, cut))").alias("left"),
        F.expr("concat_ws(' ', slice(words, cut + 1, size(words) - cut))").alias("right"))
    part = frequent.select("lang", "phrase", "f")
    scored = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).withColumn(
        "score", F.expr(f"cast({2 * SCALE} AS decimal(7, 0)) * cast(a AS decimal(19, 0)) "
                        "div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low")).select(
        "lang", "phrase", "a", "low.l", "low.r", "low.score")
    around = candidates.filter(F.size("words") > 2).select(
        "lang", "f", "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("size")).select(
        "lang", "f", F.explode(F.expr(
            "transform(sequence(1, size(words) - size + 1), i -> concat_ws(' ', slice(words, i, size)))")).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        f"around IS NULL OR 100 * cast(around AS decimal(19, 0)) < {covered} * cast(a AS decimal(19, 0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    placed = kept.withColumn("rank", F.row_number().over(order))
    if reported is not None:
        placed = placed.filter(F.col("rank") <= reported)
    return placed.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
spread AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM spread),
runs AS (SELECT lang, words, pos, unnest(range(1, {MOST_WORDS + 1})) AS size FROM places),
f AS (SELECT lang, words[pos:pos + size - 1] AS words, count(*) AS f FROM runs WHERE pos + size - 1 <= len(words)
  GROUP BY ALL HAVING count(*) >= {SUPPORT}),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM spread GROUP BY lang),
cuts AS (SELECT lang, words, f AS a, unnest(range(1, len(words))) AS cut FROM f WHERE len(words) > 1),
scored AS (SELECT c.lang, c.words, c.a, c.cut, x.f AS l, y.f AS r,
    ((2 * {SCALE}::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.words = c.words[:c.cut]
  JOIN f y ON y.lang = c.lang AND y.words = c.words[c.cut + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
inner_sizes AS (SELECT lang, f, words, unnest(range(2, len(words))) AS size FROM f WHERE len(words) > 2),
inner_places AS (SELECT lang, f, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM inner_sizes),
around AS (SELECT lang, words[pos:pos + size - 1] AS words, max(f) AS around FROM inner_places GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.words, ' ') AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.words = b.words
  WHERE o.around IS NULL OR 100::HUGEINT * o.around < {COVERED}::HUGEINT * b.a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN n USING (lang) WHERE rank <= {REPORTED}
"""


@query("op13_collocations", ORACLE_SQL)
def op13(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
