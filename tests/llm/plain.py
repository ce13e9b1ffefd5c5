"""The operators' contracts in plain Python, to compare with."""

from __future__ import annotations

import collections
import hashlib
import re

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PERSONAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def secrets(text: str) -> list[tuple[str, int, int]]:
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def spans(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def shingle_set(text: str) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(ASCII_LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def link_components(rows: list[tuple[int | None, str]]) -> list[int | None]:
    """Component id of every row, by comparing all pairs."""
    sets = [shingle_set(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in members[find(i)] if x is not None]
        out.append((min(ids) if ids else None) if sets[i] else doc_id)
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER))


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licences(text: str) -> tuple[int, list[int], str]:
    own, places, labels = words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(own) - len(p) + 1) if own[i:i + len(p)] == p]
        places += hits
        if hits:
            labels.add(label)
    return len(own), places, ",".join(sorted(labels))


def shingles(text: str) -> list[tuple]:
    own = words(text)
    return [tuple(own[i:i + 5]) for i in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] if own else []


def leaks(text: str, items: list[tuple[int, str]]) -> dict[int, float]:
    """Best similarity of every item of at least five words among the text's windows, if at least 0.75."""
    own, out = shingles(text), {}
    for item, item_text in items:
        target = shingles(item_text)
        if not target:
            continue
        if len(target[0]) < 5:
            full = words(text)
            if any(tuple(full[i:i + len(target[0])]) == target[0] for i in range(len(full))):
                out[item] = 1.0
            continue
        counts = collections.Counter(target)
        for at in range(len(own) - len(target) + 1):
            common = sum((collections.Counter(own[at:at + len(target)]) & counts).values())
            value = common / (2 * len(target) - common)
            if value >= 0.75:
                out[item] = max(value, out.get(item, 0.0))
    return out
