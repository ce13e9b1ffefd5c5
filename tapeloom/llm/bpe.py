"""Byte-pair encoding by an automaton compiled from the merges.

States are tokens: after any prefix of a word the automaton is in the state of
the last token of that prefix's encoding, and an arc from u labelled v says that
v may follow u. Compiling starts with one state per byte and every arc. Merge
number k, of u and v, is a gadget: it adds a state w whose label joins theirs,
redirects the path u -> v to it (arcs into u lead to w as well, w keeps v's
arcs), and cuts the arc u -> v. Fifty thousand gadgets would make billions of
explicit arcs, so the gadgets are kept and an arc is resolved on first use, by
undoing the later of its two states' gadgets until a cut or two bytes remain;
resolved arcs stay in a table.

Encoding a word: a byte table (the labels as a tree) gives the tokens that begin
at a position, the arc table says which of them may follow the state there. As
no position can be entered in two states, a position without a way to the end is
left for good, so the run is linear. Decoding emits the labels of the arcs.

Defined results: a null or empty text has no tokens and decodes to the empty
text; equal rows get equal results; null ids are kept; an empty table gives no
rows; further columns are ignored. The special token's string becomes its id.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.base import chunks, kept, query, table, texts
from tapeloom.llm.presplit import WordEncoder, byte_letters

#: The tokenizer file of the query.
VOCABULARY = "byte_bpe_50k.json"
class MergeAutomaton(WordEncoder):
    """See the module's text. Ids of byte states and of merged states come from the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        super().__init__(special)
        letters = byte_letters()
        self.label: dict[int, bytes] = {}
        for text, b in letters.items():
            if text in vocabulary:
                self._add_state(vocabulary[text], bytes([b]))
        #: state -> (u, v) and its gadget's number; bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        #: (u, v) -> number of the gadget that cuts the arc
        self.cut: dict[tuple[int, int], int] = {}
        for k, (u, v) in enumerate(merges):
            self._merge(k, vocabulary[u], vocabulary[v], vocabulary[u + v])
        for text, i in special.items():
            self.label[i] = text.encode()
        self._arcs: dict[int, bool] = {}
        self.tree: dict = {}
        for i, label in sorted(self.label.items()):
            if i not in special.values() and self._is_reached(i):
                node = self.tree
                for b in label:
                    node = node.setdefault(b, {})
                node[-1] = i

    @classmethod
    def load(cls, path: str) -> MergeAutomaton:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        return cls(file["model"]["vocab"], merges, {t["content"]: t["id"] for t in file["added_tokens"]})

    def _add_state(self, i: int, label: bytes) -> None:
        self.label[i] = label

    def _merge(self, k: int, u: int, v: int, w: int) -> None:
        self._add_state(w, self.label[u] + self.label[v])
        self.parts[w] = (u, v)
        self.born[w] = k
        self.cut[u, v] = k

    def arc(self, u: int, v: int) -> bool:
        """Whether v may follow u."""
        key = u << 32 | v
        known = self._arcs.get(key)
        if known is None:
            known = self._arcs[key] = self._resolve(u, v)
            if len(self._arcs) > 500_000:
                self._arcs.clear()
        return known

    def _resolve(self, u: int, v: int, before: int | None = None) -> bool:
        """Undo gadgets from the last one on; the arc falls if one of the earlier gadgets cut it.

        Of two equal merges the left one comes first: a cut by the very gadget
        that made v counts, one by the gadget that made u does not.
        """
        before = len(self.parts) if before is None else before  # gadgets with smaller numbers were at work
        while True:
            if self.cut.get((u, v), before) < before:
                return False
            born_u, born_v = self.born.get(u, -1), self.born.get(v, -1)
            if born_u < 0 and born_v < 0:
                return True
            if born_v >= born_u:
                before, v = born_v + 1, self.parts[v][0]
            else:
                before, u = born_u, self.parts[u][1]

    def _is_reached(self, w: int) -> bool:
        """Bytes always are; a merged state only if its path still stood when it was added."""
        if w not in self.parts:
            return True
        known = self._arcs.get(-w)
        if known is None:
            u, v = self.parts[w]
            known = self._arcs[-w] = (
                self._resolve(u, v, self.born[w]) and self._is_reached(u) and self._is_reached(v))
        return known

    def encode_piece(self, piece: str) -> bytes:
        return array("i", self.spell(piece.encode())).tobytes()

    def spell(self, piece: bytes) -> list[int]:
        """Ids of one pre-split word: the only path of arcs whose labels spell it."""
        size, arcs, tree = len(piece), self._arcs, self.tree
        left: set[int] = set()  # positions without a way to the end
        path: list[int] = []  # states so far
        ends = [0]  # and where they end
        ways: list[list[tuple[int, int]]] = []  # the tokens still to try at each position of the path
        at = 0
        while at < size:
            # all tokens that begin here, the longest last
            node, end, found = tree, at, []
            while end < size:
                node = node.get(piece[end])
                if node is None:
                    break
                end += 1
                v = node.get(-1)
                if v is not None:
                    found.append((v, end))
            ways.append(found)
            while True:
                if not ways:
                    raise ValueError("a byte is missing from the vocabulary")
                if not ways[-1]:
                    ways.pop()
                    left.add(ends.pop())
                    if path:
                        path.pop()
                    continue
                v, end = ways[-1].pop()
                if end in left:
                    continue
                if path:
                    follows = arcs.get(path[-1] << 32 | v)
                    if not (self.arc(path[-1], v) if follows is None else follows):
                        continue
                path.append(v)
                ends.append(end)
                at = end
                break
        return path

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, one after another; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.label.__getitem__, ids.tolist())).decode("utf-8", "replace")


def automaton(path: str) -> MergeAutomaton:
    """The automaton of a vocabulary file, compiled once per worker, which keeps it until another operator comes."""
    return kept(path, lambda: MergeAutomaton.load(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]):
        machine = automaton(path)
        for batch in chunks(batches, keeps=path):
            ids = machine.encode_all(batch.column("text").to_pylist())
            offsets = np.append(0, np.cumsum([len(i) // 4 for i in ids]))
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
                names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of encoded documents; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]):
        machine = automaton(path)
        for batch in batches:
            found = [machine.decode(np.array(i or [], np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(
        run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again and return digests of both, without moving ids out of the task."""

    def run(batches: Iterator[pa.RecordBatch]):
        machine = automaton(path)
        for batch in chunks(batches, keeps=path):
            counts, ids_sha, text_sha = [], [], []
            for ids in machine.encode_all(batch.column("text").to_pylist()):
                ids = np.frombuffer(ids, "<i4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
