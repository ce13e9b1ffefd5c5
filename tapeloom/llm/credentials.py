"""Secrets, and credentials linked from several parts, with DataFrame operations only.

Three base kinds (``assign``, ``access``, ``hex``) stand on their own. Weak parts
are reported only where complementary parts lie within the same scope: an
identifier or an endpoint near a secret, a bare token near an identifier. They are
found by an interval join on the gap between two parts, so that long parts are not
far apart: the ends of parts are bucketed by their place in the text, and a part
meets those in the buckets beside its own ends, never all others.

Texts without any part leave the plan after one scan; only the others are taken
apart. A part's place comes from the lengths of the pieces between matches.

Defined results: a null or empty text has no spans (the hash of the empty string);
equal rows get equal results; a null document id is kept; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.base import query, table, texts
from tapeloom.session import written_once

# The base kinds' patterns, their order and their least lengths.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: An identifier that names itself, a service address, and a bare mixed token.
IDENTIFIER = r"(?i:client|access|account|user|key|login)[_-]?(?i:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}"
ENDPOINT = r"(?:https?|ftp|s3|postgres|postgresql|mysql|redis|amqp|mongodb)://[A-Za-z0-9._~:/?#@%&=+-]+"
BARE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "bare")
BASE_KINDS = KINDS[:3]
#: What each weak kind needs within its scope.
NEEDS = {
    "identifier": ("assign", "hex", "bare"),
    "endpoint": ("assign", "access", "hex"),
    "bare": ("access", "identifier"),
}
#: Two parts belong to one scope if at most so many characters lie between them.
SCOPE = 256
#: A text without any of these has no part that can be reported.
GATE = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
        r"|(?i:client|access|account|user|key|login)[_-]?(?i:id|name)[\"']?\x20*[:=]")


def occurrences(rows: DataFrame, kind: str, pattern: str, group: int = 0) -> DataFrame:
    """``key, kind, start, end, value`` of every match, in code points.

    ``split`` gives what lies between matches, so a match starts where the
    pieces and matches before it end.
    """
    hits = rows.select(
        "key",
        F.posexplode(F.arrays_zip(
            F.transform(F.split("text", pattern, -1), F.length).alias("gap"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
        )).alias("at", "m"),
    ).filter(F.col("m.hit").isNotNull())
    so_far = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m.hit")
    end = F.sum(F.col("m.gap") + size).over(so_far)
    return hits.select(
        "key", F.lit(kind).alias("kind"), (end - size).cast("long").alias("start"),
        end.cast("long").alias("end"), F.col("m.value").alias("value"))


def mixed(value: Column) -> Column:
    """Has a digit, a capital and a small letter, as keys do and words do not."""
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def parts(rows: DataFrame) -> DataFrame:
    """All parts of the texts, strong and weak."""
    found = occurrences(rows, "assign", ASSIGN, 2).filter(F.length("value") >= 6)
    for kind, pattern in (("access", ACCESS), ("hex", HEX), ("identifier", IDENTIFIER), ("endpoint", ENDPOINT)):
        found = found.unionByName(occurrences(rows, kind, pattern))
    return found.unionByName(occurrences(rows, "bare", BARE).filter(mixed(F.col("value")))).drop("value")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part in their scope.

    A partner before a weak part ends in the bucket of the weak part's start or
    the one before; a partner behind it starts in the bucket of its end or the
    next. A bucket has ``scope`` characters, hence few parts, and a part meets
    two buckets on each side, however long it or the text is. A bare token that
    overlaps its partner is the partner itself and does not count.
    """
    def bucket(place: str) -> Column:
        return F.floor(F.col(place) / scope)

    def meeting(before: bool, at: Column) -> Column:
        return F.struct(F.lit(before).alias("before"), at.alias("bucket"))

    weak = found.filter(F.col("kind").isin(*NEEDS)).withColumn("look", F.explode(F.array(
        meeting(True, bucket("start") - 1), meeting(True, bucket("start")),
        meeting(False, bucket("end")), meeting(False, bucket("end") + 1))))
    other = found.select(
        F.col("key").alias("o_key"), F.col("kind").alias("o_kind"), F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
        F.explode(F.array(meeting(True, bucket("end")), meeting(False, bucket("start")))).alias("o_at"))
    needed = F.lit(False)
    for kind, partners in NEEDS.items():
        needed = needed | ((F.col("kind") == kind) & F.col("o_kind").isin(*partners))
    gap = F.when(F.col("look.before"), F.col("start") - F.col("o_end")).otherwise(F.col("o_start") - F.col("end"))
    met = weak.join(
        other,
        (F.col("key") == F.col("o_key")) & (F.col("look.before") == F.col("o_at.before"))
        & (F.col("look.bucket") == F.col("o_at.bucket")) & gap.between(0, scope) & needed,
        "left_semi")
    # a part may meet partners on both sides and in several buckets
    return met.select("key", "kind", "start", "end").distinct()


def text_key(text: Column) -> Column:
    """A digest of the text where it can have a part at all, else null."""
    return F.when(text.rlike(GATE), F.sha2(text.cast("binary"), 256))


def spans_by_key(slim: DataFrame) -> DataFrame:
    """``key, spans``: the sorted ``(start, rank, kind, end)`` of each distinct text in ``key, text``.

    ``rank`` is the kind's place in :data:`KINDS`. Texts without a span have no row.
    """
    once = slim.filter("key IS NOT NULL").select("key", "text").dropDuplicates(["key"])
    found = written_once(parts(once), "parts")
    reported = found.filter(F.col("kind").isin(*BASE_KINDS)).unionByName(linked(found))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return reported.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, spans`` per row; ``key`` is null where the text has no part at all."""
    keyed = texts(docs, id_col, text_col).withColumn("key", text_key(F.col("text")))
    slim = written_once(keyed.withColumn("text", F.when(F.col("key").isNotNull(), F.col("text"))), "secrets")
    spans = spans_by_key(slim)
    # rows without a part meet nothing: they stay out of the join, as one key would hold most of them
    bare = slim.filter("key IS NULL").select("key", "doc_id", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return slim.filter("key IS NOT NULL").select("key", "doc_id").join(spans, "key", "left").unionByName(bare)


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with every span of their texts masked."""
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn("__key", text_key(text))
    hit = keyed.filter("__key IS NOT NULL")
    slim = written_once(hit.select(F.col("__key").alias("key"), text.alias("text")), "secrets")
    spans = spans_by_key(slim).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    changed = hit.join(spans, "__key", "left").withColumn(text_col, masked(text, F.col("__spans")))
    return keyed.filter("__key IS NULL").select(*docs.columns).unionByName(changed.select(*docs.columns))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(
        F.coalesce(spans, F.array()), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def is_base(span: Column) -> Column:
    return span["kind"].isin(*BASE_KINDS)


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlaps merged, replaced by the mask.

    The spans' ends make the pieces to keep: a piece runs from the largest end
    so far to the next start.
    """
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("out"))

    def step(done, span):
        fresh = span["start"] >= done["end"]
        piece = F.substr(text, (done["end"] + 1).cast("int"), (span["start"] - done["end"]).cast("int"))
        return F.struct(
            F.greatest(done["end"], span["end"]).alias("end"),
            F.when(fresh, F.concat(done["out"], piece, F.lit(mask))).otherwise(done["out"]).alias("out"))

    return F.when(F.size(F.coalesce(spans, F.array())) == 0, text).otherwise(F.aggregate(
        spans, start, step,
        lambda done: F.concat(done["out"], F.substr(text, (done["end"] + 1).cast("int")))))


@query("op9_secret_scan")
def op9(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    kinds = F.transform(spans, lambda s: s["kind"])
    count = {k: F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long") for k in BASE_KINDS}
    return found.select(
        "doc_id", *[count[k].alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(F.filter(spans, is_base)), 256).alias("base_sha256"),
        span_text(spans).alias("spans"))
