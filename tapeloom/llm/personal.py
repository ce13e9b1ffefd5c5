"""Personal data: four base kinds by rule, and what a trained tagger finds besides.

The base kinds (``email``, ``ip``, ``card``, ``phone``) are found in every whole
text and always reported. A character-level bidirectional LSTM with a CRF is
trained from them as labelled spans, and from rewritings of them that the rules
miss (an at-sign in words, a phone without its plus, other separators). It reads
overlapping windows; their tag probabilities are merged place by place, places
deep in a window counting more, and one best path per stretch decides, so a span
cut by a window's edge comes out whole.

Every such span holds a digit or an at-sign, or an ``at`` in brackets; windows
are laid around all of those. Beside an ``at`` they reach over the whole name and
domain: a window around the ``at`` decides whether it is an address, and the name's
and the domain's characters say how far it goes, however long they are. A found span is reported
if the tagger is sure, its kind's own check holds (digits, Luhn, parts up to 255),
and no base span overlaps it.

Training takes a bounded number of windows, chosen by a hash over all documents;
everything else covers all rows.

Defined results: a null or empty text has no spans (the hash of the empty
string); equal texts get equal results; null ids are kept; without any base span
nothing is trained and nothing added; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import chunks, query, table, texts, utf8
from tapeloom.llm.sequence_model import PAD, Tagger, classes
from tapeloom.session import written_once

Span = tuple[str, int, int]

# Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters of a window, and steps between windows; room kept around what calls for one.
WINDOW, STRIDE, ROOM = 48, 24, 20
#: Windows trained on: so many of each kind, and so many without any span.
PER_KIND, WITHOUT = 250, 500
#: Least mean probability of a reported span's tags, chosen on rewritten spans kept out of
#: training: likelier than not, and more for phones, whose own check is only a count of digits.
SURE = {"email": 0.5, "ip": 0.5, "card": 0.5, "phone": 0.7}
_AT_WORD = re.compile(r"[\[(]\s?at\s?[\])]", re.IGNORECASE)
_AT = re.compile(f"@|{_AT_WORD.pattern}", re.IGNORECASE)
_HOST = _LOCAL - frozenset("_%+")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, odd)) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[Span]:
    """At every at-sign: the run of local characters before it, as far as the last match, and a domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        # a run that fails with this at-sign cannot be part of a later match
        done = domain.end() if domain else at + 1
        if domain:
            out.append(("email", start, domain.end()))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans by kind as listed, then start."""
    out = emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# -- windows -------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that can hold a span, with room on both sides.

    Beside an at-sign, as a sign or in brackets, the room begins where the address does.
    """
    calls = [(m.start(), m.end()) for m in re.finditer("[0-9]", text)]
    calls += [address(text, m.start(), m.end()) for m in _AT.finditer(text)]
    out: list[list[int]] = []
    for start, end in sorted(calls):
        low, high = max(0, start - ROOM), min(len(text), end + ROOM)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def address(text: str, start: int, end: int) -> tuple[int, int]:
    """The mark at ``start:end`` with the runs of local characters before it and of domain characters behind it.

    Spaces may stand beside the mark. Runs hold no mark, so a character is read for two marks at most.
    """
    low, high = start, end
    while low and text[low - 1].isspace():
        low -= 1
    while low and text[low - 1] in _LOCAL:
        low -= 1
    while high < len(text) and text[high].isspace():
        high += 1
    while high < len(text) and text[high] in _HOST:
        high += 1
    return low, high


def window_starts(low: int, high: int) -> list[int]:
    return list(range(low, max(low + 1, high - WINDOW + STRIDE), STRIDE))


def padded(codes: np.ndarray) -> np.ndarray:
    return np.append(codes, np.full(WINDOW - len(codes), PAD)) if len(codes) < WINDOW else codes


def written_addresses(text: str) -> list[tuple[int, int, int, int]]:
    """Whole addresses with an at in brackets: their start and end, and the mark's."""
    out = []
    for m in _AT_WORD.finditer(text):
        start, high = address(text, m.start(), m.end())
        behind = next((k for k in range(m.end(), high) if text[k] in _HOST), high)
        domain = _DOMAIN.match(text, behind)
        if text[start] in _LOCAL and domain:
            out.append((start, domain.end(), m.start(), m.end()))
    return out


# -- training ------------------------------------------------------------------------


def rewritings(kind: str, span: str) -> list[str]:
    """Ways of writing a span that the base rules miss."""
    if kind == "email":
        name, _, host = span.partition("@")
        # names and domains of any length, with digits or without
        own, far = re.sub("[^A-Za-z]", "", name) or "x", re.sub("[0-9]", "", host)
        long = f"{own}{own[::-1]}.{own}ina{own}"
        return [f"{name} (at) {host}", f"{name} [at] {host}", f"{name}(at){host}", f"{own} (at) {own[::-1]}.{far}",
                f"{long} (at) {far}", f"{long} [at] {own}-{own[::-1]}.{far}", f"{long}(at){own}.{own[::-1]}{own}.{far}"]
    if kind == "phone":
        bare = span[1:]
        return [f"tel. {bare}", f"00{bare}", bare.replace(" ", ".")]
    if kind == "card":
        digits = only_digits(span)
        groups = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(groups), "/".join(groups)]
    return [span.replace(".", "[.]"), span.replace(".", " . ")]


def examples(text: str) -> list[tuple[str, str, int, int]]:
    """Training windows of a text: ``kind, window, start, end`` of one span each (kind empty: none).

    Spans stand at varied places of their windows and may be cut by the end, and
    long names by the start, as they are when texts are read.
    """
    found = base_spans(text)
    out = []
    for k, (kind, start, end) in enumerate(found):
        for j, new in enumerate([text[start:end], *rewritings(kind, text[start:end])]):
            low = max(0, start - 2 - (start * 31 + j * 17) % (WINDOW - 22))
            if any(s < low + WINDOW + end - start and low < e for i, (_, s, e) in enumerate(found) if i != k):
                continue  # another span in sight would be taught as none
            window = (text[low:start] + new + text[end:end + WINDOW])[:WINDOW]
            lead = 5 if new.startswith("tel. ") else 0
            first, last = start - low + lead, min(WINDOW, start - low + len(new))
            if first < last:
                out.append((kind, window, first, last))
            mark = _AT_WORD.search(new) if kind == "email" else None
            if mark is not None and mark.start() > ROOM:
                cut = new[mark.start() - 1 - (start * 31 + j * 17) % ROOM:]
                out.append((kind, (cut + text[end:end + WINDOW])[:WINDOW], 0, min(WINDOW, len(cut))))
    for low, high in stretches(text):
        if not any(s < high + WINDOW and low < e for _, s, e in found):
            out.append(("", text[low:low + WINDOW], 0, 0))
    return out


def trained_tagger(docs: DataFrame, per_kind: int = PER_KIND, without: int = WITHOUT) -> Tagger | None:
    """A tagger trained on a bounded sample of the documents' windows; none without spans."""
    schema = pa.schema([("kind", pa.string()), ("window", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def gather(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches):
            rows = [x for text in flagged(batch.column("text")).values() for x in examples(text)]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = written_once(docs.select("text").mapInArrow(
        gather, "kind string, window string, start int, end int").distinct(), "windows")
    picked = []
    for kind, n in (*((k, per_kind * 3) for k in KINDS), ("", without)):
        mine = rows.filter(F.col("kind") == kind)
        picked += mine.orderBy(F.xxhash64("window"), "window", "start").limit(n).collect()
    if not any(r["kind"] for r in picked):
        return None
    codes = np.stack([padded(classes(r["window"])) for r in picked])
    tags = np.zeros(codes.shape, int)
    for i, r in enumerate(picked):
        if r["kind"]:
            tags[i, r["start"]:r["end"]] = 2 + 2 * KINDS.index(r["kind"])
            tags[i, r["start"]] -= 1
    return Tagger(KINDS).fit(codes, tags)


# -- tagging -------------------------------------------------------------------------


def flagged(column) -> dict[int, str]:
    """Texts with a digit, an at-sign or a bracket, by row."""
    data, offsets = utf8(column)
    telling = ((data >= 48) & (data <= 57)) | (data == 64) | (data == 91) | (data == 40)
    before = np.append(0, np.cumsum(telling))[offsets]
    return {int(i): column[int(i)].as_py() for i in np.flatnonzero(np.diff(before))}


def plausible(kind: str, span: str) -> bool:
    """The kind's own check of a tagged span."""
    digits = only_digits(span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return "@" in span and "." in span or bool(written_addresses(span))


def added_spans(found: dict[int, str], base: dict[int, list[Span]], tagger: Tagger, batch: int = 512) -> dict[int, list[Span]]:
    """Spans of the tagger beyond the base spans, by row."""
    places, codes = [], []
    for i, text in found.items():
        own = classes(text)
        for low, high in stretches(text):
            for start in window_starts(low, high):
                places.append((i, low, high, start))
                codes.append(padded(own[start:start + WINDOW]))
    # places deep inside a window weigh more than those at its edges
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))[:, None].astype(float)
    merged: dict[tuple[int, int], list] = {}
    for at in range(0, len(codes), batch):
        probable = np.log(np.maximum(tagger.marginals(np.stack(codes[at:at + batch])), 1e-12))
        for (i, low, high, start), p in zip(places[at:at + batch], probable):
            if (i, low) not in merged:
                merged[i, low] = [np.zeros((high - low, p.shape[1])), np.zeros((high - low, 1)), high]
            n = min(WINDOW, high - start)
            merged[i, low][0][start - low:start - low + n] += (p * weight)[:n]
            merged[i, low][1][start - low:start - low + n] += weight[:n]
    out: dict[int, list[Span]] = {}
    whole = whole_addresses(found, base, tagger, batch)
    for i, spans in whole.items():
        out[i] = [("email", *span) for span in spans]
    for (i, low), (sums, weights, _) in merged.items():
        mean = sums / weights
        tags = tagger.best_path(mean)
        t = 0
        while t < len(tags):
            if tags[t] % 2 == 0:
                t += 1
                continue
            kind, end = KINDS[tags[t] // 2], t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            start, stop = low + t, low + end
            sure = np.exp(mean[np.arange(t, end), tags[t:end]]).mean()
            if (sure >= SURE[kind] and plausible(kind, found[i][start:stop])
                    and not any(s < stop and start < e for _, s, e in base[i])
                    and not any(s < stop and start < e for s, e in whole.get(i, ()))):
                out.setdefault(i, []).append((kind, start, stop))
            t = end
    return out


def whole_addresses(found: dict[int, str], base: dict[int, list[Span]], tagger: Tagger,
                    batch: int) -> dict[int, list[tuple[int, int]]]:
    """Addresses with an at in brackets: a window around the mark decides, the address's characters say how far it reaches."""
    places, codes = [], []
    for i, text in found.items():
        written = written_addresses(text) if "[" in text or "(" in text else []
        own = classes(text) if written else None
        for start, stop, a, b in written:
            if not any(s < stop and start < e for _, s, e in base[i]):
                low = max(0, (a + b - WINDOW) // 2)
                places.append((i, start, stop, a - low, b - low))
                codes.append(padded(own[low:low + WINDOW]))
    email = 1 + 2 * KINDS.index("email")
    out: dict[int, list[tuple[int, int]]] = {}
    for at in range(0, len(codes), batch):
        probable = tagger.marginals(np.stack(codes[at:at + batch]))
        for (i, start, stop, a, b), p in zip(places[at:at + batch], probable):
            if p[a:b, email:email + 2].sum(axis=1).mean() >= SURE["email"]:
                out.setdefault(i, []).append((start, stop))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       tagger: Tagger | None = None) -> DataFrame:
    """``doc_id``, the number of base spans per kind, ``base_sha256`` and ``spans`` of every document."""
    docs = texts(docs, id_col, text_col)
    tagger = tagger or trained_tagger(docs)
    nothing = hashlib.sha256(b"").hexdigest()
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches):
            n = batch.num_rows
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            found = flagged(batch.column("text"))
            base = {i: base_spans(t) for i, t in found.items()}
            added = added_spans(found, base, tagger) if tagger is not None else {}
            for i, own in base.items():
                for kind, _, _ in own:
                    counts[order[kind], i] += 1
                digest[i] = hashlib.sha256(joined(own).encode()).hexdigest()
                spans[i] = joined(sorted(own + added.get(i, []), key=lambda s: (order[s[0]], s[1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


@query("op2_personal_data")
def op2(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))
