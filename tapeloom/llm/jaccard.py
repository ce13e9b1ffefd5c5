"""Exact Jaccard join of word shingles by trees of count vectors.

A document is the set of its distinct five-word shingles; two link if
100 * |A and B| >= 75 * |A or B|. Equal sets are one node. Two steps follow.

*Which sets can link at all.* Of linked sets A and B, at most a quarter of A is
not in B. So the l smallest hashes they share are among the first
``n // 4 + l`` hashes of both, and a set needs ``need(n)`` hashes in that prefix
which some other set's prefix holds too. One exchange by hash counts the holders
of every prefix hash, a second by set drops the sets that fail (most do). The
larger a table, the more sets pass by chance: what a set shares with many others,
a bit with each, counts like what it shares with one. So the sets that pass are
exchanged whole, among themselves, and need three quarters of their hashes held by
others: chance takes twice as much. A second exchange drops those that fail and
orders the hashes of the others by their number of holders: linked sets share
one of the rarest ``held - need_whole(n) + 1``. Sets that share such a hash are joined
to candidate components, stars instead of pairs. Hashes that a thousandth of all
sets hold are recognised while scanning and never gathered in one place. An entry
of an exchange has 32 bits of a hash, whose slice tells the others.

*Which of them do.* Hashes are dealt into groups, the counts per group are a
point, and the points of a candidate component are indexed by an R-tree. The
overlap of two sets is at most the sum of the smaller counts; with a node's
largest counts that bounds all its points at once. Points that pass are compared
exactly. Every set is looked up once among those not yet reached, and what it
links is reached: a group of copies costs a comparison each, not one per pair.
Components beyond the size of a leaf are dealt into leaves; pivots of the leaves'
parts are compared next, then all sets that are still outside the largest part
meet all others in blocks, as points; those that the bound allows a link meet as sets.

Hashes have 64 bits: sets are compared by hashes, and a node is named by 64 bits
of the digest of all its hashes.

Defined results: a text without words has an empty set, is its own component and
links with nothing; fewer than five words make one shingle; equal texts share a
component; rows with a null id link like others, and a component without any id
has a null one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import words as w
from tapeloom.llm.base import chunks, query, table, texts, utf8
from tapeloom.llm.components import components
from tapeloom.session import scratch_path, scratch_scope, shuffles_dropped, written_once

#: A hash is frequent if this share of the documents holds it (counted with an error of half of it).
FREQUENT = 0.001
#: Sets in a leaf of a candidate component; points in a node of a tree.
LEAF, NODE = 256, 16
#: Prefix hashes a task gathers before it sends them on, and those of a slice on average.
FLUSH, SLICE = 1 << 19, 1 << 20
#: Bits of the bitmap of wanted nodes for each of them, and at most.
FILTER_EACH, FILTER_BITS = 12, 1 << 25
#: Holders of a hash are counted up to this; frequent ones rank beyond.
MOST_HELD = 60_000


def links(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def need(n: np.ndarray) -> np.ndarray:
    """Prefix hashes that any set linked with one of ``n`` shares with it, at least."""
    return 1 + ((3 * n + 3) // 4) // 4


def need_whole(n: np.ndarray) -> np.ndarray:
    """Hashes that any set linked with one of ``n`` shares with it, at least."""
    return (3 * n + 3) // 4


def prefix(n: int) -> int:
    return 1 + 2 * (n // 4)


def shingle_sets(column) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = utf8(column)
    lower = w.LOWER[data]
    found = w.find_words(lower, offsets, w.NOT_SPACE)
    hashes = w.hash_words(lower, found)
    runs = w.hash_runs(hashes)
    for low, high in zip(found.first.tolist(), found.first[1:].tolist()):
        yield np.unique(w.shingles(runs, hashes, low, high))


def node_of(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


# -- which sets can link at all ---------------------------------------------------


def scan_sets(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n, node`` (``token`` null), and reports of hashes that many of a task's sets hold.

    A hash held by ``FREQUENT`` of all sets is reported by tasks that see more
    than half of them, so the reports add up to at least half its holders.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        gathered: list[np.ndarray] = []
        sets = size = 0

        def report():
            tokens, n = np.unique(np.concatenate(gathered), return_counts=True)
            many = n >= max(32, FREQUENT / 2 * sets)
            return rows(token=tokens[many].view(np.int64), held=n[many])

        def rows(**given):
            size = max(map(len, given.values()))
            return pa.RecordBatch.from_arrays(
                [pa.array(given[c], pa.int64()) if c in given else pa.nulls(size, pa.int64()) for c in columns],
                names=columns)

        for batch in chunks(batches):
            n, nodes = [], []
            for own in shingle_sets(batch.column("text")):
                n.append(len(own))
                nodes.append(node_of(own) if len(own) else None)
                if len(own) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    gathered.append(own)
                    sets += 1
                    size += len(gathered[-1])
            yield rows(doc_id=batch.column("doc_id"), n=n, node=nodes)
            if size >= 2 * FLUSH:
                yield report()
                gathered, sets, size = [], 0, 0
        if gathered:
            yield report()

    columns = ["doc_id", "n", "node", "token", "held"]
    return written_once(docs.mapInArrow(run, ", ".join(f"{c} long" for c in columns)), "sets")


_BINARY = ("nodes", "sizes", "extra", "runs", "low", "held")
PACKED = f"part int, slice int, {', '.join(f'{c} binary' for c in _BINARY)}"
EDGES = "a long, b long"
_PACKED = pa.schema([("part", pa.int32()), ("slice", pa.int32()), *((c, pa.binary()) for c in _BINARY)])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Slice of rows that hold sets with their frequent hashes, or edges.
NO_SLICE = -1


def narrow(x: np.ndarray) -> bytes:
    """Counts from 1 on in as few bytes as the largest takes; none if all are 1."""
    most = int(x.max()) if len(x) else 1
    return b"" if most == 1 else x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if data else np.ones(n, np.int64)


def pack(part: np.ndarray, slice_: int | np.ndarray, node: np.ndarray, **entries: np.ndarray) -> pa.RecordBatch:
    """Entries as one row per part; a node's entries in a part stand together and name it once.

    ``slice_`` is one for all, or that of each part's number.
    """
    order = np.lexsort((node, part))
    part, node = part[order], node[order]
    entries = {c: x[order] for c, x in entries.items()}
    fresh = np.ones(len(part), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (node[1:] != node[:-1])
    firsts = np.flatnonzero(fresh)
    runs = np.diff(np.append(firsts, len(part)))
    parts, at = np.unique(part, return_index=True)
    ends = np.append(at[1:], len(part))
    a, b = np.searchsorted(firsts, at), np.searchsorted(firsts, ends)
    names = node[firsts].astype("<i8")
    columns = {"nodes": [names[i:j].tobytes() for i, j in zip(a, b)], "runs": [narrow(runs[i:j]) for i, j in zip(a, b)]}
    columns |= {c: [x[i:j].tobytes() for i, j in zip(at, ends)] for c, x in entries.items()}
    return packed(parts, slice_, columns)


def packed(parts: np.ndarray, slice_: int | np.ndarray, columns: dict[str, list[bytes]]) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(np.broadcast_to(slice_, n), pa.int32()),
         *(pa.array(columns.get(c, [b""] * n), pa.binary()) for c in _BINARY)], schema=_PACKED)


def packed_sets(part: np.ndarray, node: np.ndarray, size: np.ndarray, extra: np.ndarray,
                frequent: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """A row per part with its sets; ``frequent`` has the places of each set's frequent hashes among all."""
    order = np.argsort(part, kind="stable")
    parts, at = np.unique(part[order], return_index=True)
    rows = np.split(order, at[1:])
    columns = {"nodes": [node[r].astype("<i8").tobytes() for r in rows], "sizes": [size[r].astype("<u4").tobytes() for r in rows],
               "extra": [extra[r].astype("<u4").tobytes() for r in rows]}
    if frequent is not None:
        columns |= {"runs": [np.array([len(frequent[i]) for i in r], "<u4").tobytes() for r in rows],
                    "low": [np.concatenate([frequent[i] for i in r]).astype("<u4").tobytes() for r in rows]}
    return packed(parts, NO_SLICE, columns)


def unpack(rows: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """Rows of sets as they are; node, token and held of the entries of all others."""
    named, node, token, held = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in rows.to_pylist():
        if r["slice"] == NO_SLICE:
            named.append(r)
            continue
        names = np.frombuffer(r["nodes"], "<i8")
        low = np.frombuffer(r["low"], "<u4").astype(np.int64)
        node.append(np.repeat(names, wide(r["runs"], len(names))))
        token.append(np.int64(r["slice"] << 32) | low)
        held.append(np.frombuffer(r["held"], "<u2").astype(np.int64) if r["held"] else np.zeros(len(low), np.int64))
    return named, *(np.concatenate(x) for x in (node, token, held))


def sets_of(named: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, size and extra of the sets in some rows, each set once, ascending."""
    node, size, extra = (np.concatenate([np.frombuffer(r[c], t).astype(np.int64) for r in named] or [np.empty(0, np.int64)])
                         for c, t in (("nodes", "<i8"), ("sizes", "<u4"), ("extra", "<u4")))
    node, first = np.unique(node, return_index=True)
    return node, size[first], extra[first]


def bucket_of(node: np.ndarray, parts: int) -> np.ndarray:
    return (w.mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def slices_for(hashes: int) -> int:
    return 1 << int(np.clip(np.ceil(np.log2(max(1, hashes) / SLICE)), 6, 15))


def sent_sets(docs: DataFrame, hot: np.ndarray, slices: int, buckets: int, within=None) -> DataFrame:
    """The sets of ``docs``, each task's once, as entries of their hashes by slice.

    Of every set its prefix travels, or with ``within``, a broadcast bitmap, the
    whole sets of the nodes in it. An entry has the 32 bits of a hash above those
    that tell its slice: unlike hashes that these leave alike are held together,
    which can only add candidates, and where that befalls one set it is told how
    many it lost (``extra``). Parts below ``slices`` are slices of the hashes;
    those beyond are buckets of nodes, which get the sets with their frequent
    hashes at once.
    """
    bits = slices.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        held: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            nodes, sizes, extra = (np.array([x[i] for x in held], np.int64) for i in range(3))
            yield packed_sets(slices + bucket_of(nodes, buckets), nodes, sizes, extra,
                              [x[3] for x in held] if within is not None else None)
            token = np.concatenate([x[4] for x in held])
            if len(token):
                part = token & np.int64(slices - 1)
                yield pack(part, np.unique(part), np.repeat(nodes, [len(x[4]) for x in held]),
                           low=(token >> np.int64(bits)).astype("<u4"))

        for batch in chunks(batches):
            for own in shingle_sets(batch.column("text")):
                if not len(own):
                    continue
                node = node_of(own)
                if node in seen or within is not None and not has_bit(within.value, node):
                    continue
                seen.add(node)
                n = len(own)
                if within is None:
                    own = own[:prefix(n)]
                often = np.empty(0, np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    known = hot[at] == own
                    often, own = at[known], own[~known]
                short = np.unique(own & np.uint64((1 << 32 + bits) - 1)).view(np.int64)
                # of a prefix, frequent hashes are only counted
                extra = len(own) - len(short) + (len(often) if within is None else 0)
                held.append((node, n, extra, often, short))
                size += len(short) + len(often)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, PACKED)


def holders(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, token and number of holders of a slice's entries whose token several nodes hold."""
    _, node, token, _ = unpack(rows)
    order = np.lexsort((node, token))
    node, token = node[order], token[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    node, token = node[fresh], token[fresh]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    n = np.diff(np.append(np.flatnonzero(first), len(token)))
    n = np.repeat(n, n)
    some = n > 1
    return node[some], token[some], n[some]


def to_buckets(rows: pa.Table, slices: int) -> pa.Table:
    return rows.set_column(0, "part", pa.array(rows.column("part").to_numpy() - slices, pa.int32()))


def table_of(*batches: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches(batches, _PACKED)


def may_link(docs: DataFrame, hot: np.ndarray, slices: int) -> DataFrame:
    """``node, n`` of the sets with enough hashes in their prefix that others' prefixes hold too; two exchanges."""
    buckets = max(64, slices // 8)

    def count(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() >= slices:
            return to_buckets(rows, slices)
        node, _, _ = holders(rows)
        if not len(node):
            return table_of()
        # of each node only their number goes on
        return table_of(pack(bucket_of(node, buckets), rows.column("slice")[0].as_py(), node))

    def judge(rows: pa.Table) -> pa.Table:
        named = [r for r in rows.to_pylist() if r["slice"] == NO_SLICE]
        node, size, total = sets_of(named)
        for r in rows.to_pylist():
            if r["slice"] != NO_SLICE:
                names = np.frombuffer(r["nodes"], "<i8")
                total[np.searchsorted(node, names)] += wide(r["runs"], len(names))
        passes = total >= need(size)
        return pa.table([pa.array(node[passes]), pa.array(size[passes])], names=["node", "n"])

    return (sent_sets(docs, hot, slices, buckets).groupBy("part").applyInArrow(count, PACKED)
            .groupBy("part").applyInArrow(judge, "node long, n long"))


def candidate_edges(docs: DataFrame, within, frequent: dict[int, int], slices: int) -> DataFrame:
    """Edges between sets that may link, by the whole sets of the nodes in the bitmap ``within``; three exchanges."""
    hot = np.array(sorted(frequent), np.uint64)
    hot_rank = np.array([MOST_HELD + int(64 * np.log2(max(2, frequent[int(t)]))) for t in hot], np.int64)
    buckets = max(64, slices // 2)

    def count(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() >= slices:
            return to_buckets(rows, slices)
        node, token, n = holders(rows)
        if not len(node):
            return table_of()
        return table_of(pack(bucket_of(node, buckets), rows.column("slice")[0].as_py(), node,
                             low=(token & 0xFFFFFFFF).astype("<u4"), held=np.minimum(n, MOST_HELD - 1).astype("<u2")))

    def choose(rows: pa.Table) -> pa.Table:
        """Drop nodes with too few shared hashes; of the others send the rarest on."""
        named, node, token, held = unpack(rows)
        nodes, sizes, extra = sets_of(named)
        # frequent hashes by their places, negative
        at = np.concatenate([np.frombuffer(r["low"], "<u4").astype(np.int64) for r in named])
        if len(at):
            node = np.append(node, np.concatenate([
                np.repeat(np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["runs"], "<u4")) for r in named]))
            token, held = np.append(token, -1 - at), np.append(held, hot_rank[at])
        order = np.lexsort((token, held, node))
        node, token, held = node[order], token[order], held[order]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        node, token, held = node[fresh], token[fresh], held[fresh]
        which = np.searchsorted(nodes, node)
        total = np.bincount(which, minlength=len(nodes))
        place = np.arange(len(node)) - (np.cumsum(total) - total)[which]
        kept = place <= (total + extra - need_whole(sizes))[which]
        node, token = node[kept], token[kept]
        rare = token >= 0
        out = []
        if rare.any():
            part = token[rare] >> 32
            out.append(pack(part, np.unique(part), node[rare], low=(token[rare] & 0xFFFFFFFF).astype("<u4")))
        if (~rare).any():
            # a frequent hash is a vertex of its own; here its nodes need one edge to it between them
            known = hot[-1 - token[~rare]]
            a, b = stars(known, node[~rare])
            known, at = np.unique(known, return_index=True)
            a = np.append(a, w.mix(known).view(np.int64))
            b = np.append(b, node[~rare][at])
            pairs = np.unique(np.stack([a, b]), axis=1)
            part = bucket_of(pairs[0], buckets)
            order = np.argsort(part, kind="stable")
            parts, at = np.unique(part[order], return_index=True)
            rows_ = np.split(order, at[1:])
            out.append(packed(slices + parts, NO_SLICE, {
                c: [x[r].astype("<i8").tobytes() for r in rows_] for c, x in (("nodes", pairs[0]), ("low", pairs[1]))}))
        return table_of(*out)

    def join(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() >= slices:
            a, b = (np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows.column(c)]) for c in ("nodes", "low"))
            return pa.table([pa.array(a), pa.array(b)], schema=_EDGES)
        _, node, token, _ = unpack(rows)
        a, b = stars(token, node)
        pairs = np.unique(np.stack([a, b]), axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], schema=_EDGES)

    return (sent_sets(docs, hot, slices, buckets, within).groupBy("part").applyInArrow(count, PACKED)
            .groupBy("part").applyInArrow(choose, PACKED)
            .groupBy("part").applyInArrow(join, EDGES))


def stars(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token, edges from its least node to the others."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    starts = np.flatnonzero(first)
    least = np.repeat(node[starts], np.diff(np.append(starts, len(token))))
    other = least != node
    return least[other], node[other]


# -- which of them do --------------------------------------------------------------


def groups_for(sizes: np.ndarray) -> int:
    """Groups, a power of two, such that a typical set has few hashes in each."""
    typical = float(np.median(sizes)) if len(sizes) else 1.0
    return 1 << int(np.clip(np.ceil(np.log2(max(typical, 1) / 3)), 4, 10))


def point(own: np.ndarray, groups: int) -> np.ndarray:
    """Counts of a set's hashes per group."""
    shift = np.uint64(64 - (groups.bit_length() - 1))
    return np.bincount((own >> shift).astype(np.int64), minlength=groups)


class CountTree:
    """An R-tree over count vectors: packed nodes of points, and nodes of nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order: list[np.ndarray] = []

        def split(rows: np.ndarray) -> None:
            if len(rows) <= NODE:
                order.append(rows)
                return
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            by = sizes[rows] if np.ptp(sizes[rows]) >= spread.max() else points[rows][:, spread.argmax()]
            rows = rows[np.argsort(by, kind="stable")]
            half = -(-len(rows) // (2 * NODE)) * NODE
            split(rows[:half])
            split(rows[half:])

        split(np.arange(len(sizes)))
        self.nodes = order
        self.top, self.least, self.most = self._bounds(order, points, sizes, sizes)
        self.uppers = [np.arange(i, min(i + NODE, len(order))) for i in range(0, len(order), NODE)]
        self.upper_top, self.upper_least, self.upper_most = self._bounds(
            self.uppers, self.top, self.least, self.most)

    @staticmethod
    def _bounds(groups, points, least, most):
        return (np.stack([points[g].max(axis=0) for g in groups]), np.array([least[g].min() for g in groups]),
                np.array([most[g].max() for g in groups]))

    @staticmethod
    def _passes(q: np.ndarray, n: int, top: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Rows that may hold a set linked with ``q``: sizes within 3:4, and enough overlap by the summed minima."""
        fits = np.flatnonzero((4 * most >= 3 * n) & (3 * least <= 4 * n))
        if not len(fits):
            return fits
        overlap = np.minimum(q, top[fits]).sum(axis=1)
        return fits[7 * overlap >= 3 * (n + least[fits])]

    def reach(self, q: np.ndarray, n: int, alive: np.ndarray) -> np.ndarray:
        """Living points that pass the bound."""
        uppers = self._passes(q, n, self.upper_top, self.upper_least, self.upper_most)
        if not len(uppers):
            return uppers
        nodes = np.concatenate([self.uppers[u] for u in uppers])
        nodes = nodes[self._passes(q, n, self.top[nodes], self.least[nodes], self.most[nodes])]
        if not len(nodes):
            return nodes
        rows = np.concatenate([self.nodes[k] for k in nodes])
        rows = rows[alive[rows]]
        return rows[self._passes(q, n, self.points[rows], self.sizes[rows], self.sizes[rows])]


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def reached(sets: list[np.ndarray]) -> np.ndarray:
    """Component number of every set: each is looked up once among those not reached yet."""
    sizes = np.array([len(s) for s in sets])
    groups = groups_for(sizes)
    points = np.stack([point(s, groups) for s in sets])
    tree = CountTree(points, sizes)
    alive = np.ones(len(sets), bool)
    label = np.full(len(sets), -1)
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], label[seed], queue = False, seed, [seed]
        while queue and alive.any():
            q = queue.pop()
            for c in tree.reach(points[q], int(sizes[q]), alive).tolist():
                if links(common(sets[q], sets[c]), int(sizes[q]), int(sizes[c])):
                    alive[c], label[c] = False, seed
                    queue.append(c)
    return label


def join_leaf(rows: pa.Table) -> pa.Table:
    """Edges from the least node of each component within one leaf."""
    nodes = rows.column("node").to_numpy()
    nodes, first = np.unique(nodes, return_index=True)
    column = rows.column("hashes")
    label = reached([np.frombuffer(column[int(i)].as_py(), "<u8") for i in first])
    # nodes ascend, so a component's first is its least
    return pa.table([pa.array(nodes[label]), pa.array(nodes)], schema=_EDGES)


def wanted_bits(wanted: DataFrame, n: int) -> np.ndarray:
    """A bitmap with the bit of each of ``n`` wanted nodes set: at most ``FILTER_BITS / 64`` rows come here."""
    size = min(FILTER_BITS, 1 << max(10, (FILTER_EACH * n).bit_length()))
    place = F.pmod(F.col("node"), F.lit(size))
    words = wanted.select(F.floor(place / 64).cast("int").alias("word"), F.expr(
        "shiftleft(1L, CAST(pmod(node, 64) AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 64, np.int64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def has_bit(bits: np.ndarray, node: int) -> bool:
    place = node % (64 * len(bits))
    return bool(int(bits[place // 64]) >> place % 64 & 1)


def member_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The sets of the ``n`` nodes in ``wanted``, with its columns: ``hashes binary``.

    A bitmap of bounded size keeps most other sets from the exchange; the join
    decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted_bits(wanted, n))

    def run(batches: Iterator[pa.RecordBatch]):
        bits, seen = shared.value, set()
        for batch in chunks(batches):
            nodes, found = [], []
            for own in shingle_sets(batch.column("text")):
                if not len(own):
                    continue
                node = node_of(own)
                if node in seen or not has_bit(bits, node):
                    continue
                seen.add(node)
                nodes.append(node)
                found.append(own.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "hashes"])

    sets = docs.select("text").mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])
    return written_once(sets.join(wanted, "node"), "members")


def dealt(nodes: DataFrame, leaf: int) -> DataFrame:
    """Adds ``leaf`` to ``node, candidate``: components beyond the size of a leaf are dealt by a hash, single nodes dropped."""
    # written, so that both sides of the join are plain exchanges and a large component's can be split
    sizes = written_once(nodes.groupBy("candidate").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(
        "candidate", F.ceil(F.col("k") / leaf).alias("leaves")), "sizes")
    return nodes.join(sizes, "candidate").withColumn("leaf", F.pmod(F.xxhash64("node"), F.col("leaves")))


def largest_parts(parted: DataFrame) -> DataFrame:
    """Per candidate component of several current parts the largest (``main``), and the number of sets in all and outside it."""
    counts = parted.groupBy("candidate", "root").agg(F.count(F.lit(1)).alias("k"))
    return written_once(counts.groupBy("candidate").agg(
        F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("total"),
        (F.sum("k") - F.max("k")).alias("outside")).filter("outside > 0"), "main")


def blocks(n: str, size: int):
    """The blocks of ``size`` rows on average that ``n`` rows are dealt into."""
    return F.ceil(F.col(n) / size).cast("long")


def block(n: str, size: int):
    return F.pmod(F.xxhash64("node"), blocks(n, size))


def numbers(n: str, size: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks(n, size) - 1))


def link_outer(rows: pa.Table) -> pa.Table:
    """Edges from the ``outer`` sets of some rows to others under another root, one per root."""
    sets = [np.frombuffer(h.as_py(), "<u8") for h in rows.column("hashes")]
    sizes = np.array([len(s) for s in sets])
    is_outer = rows.column("outer").to_numpy(zero_copy_only=False)
    root, node = rows.column("root").to_numpy(), rows.column("node").to_numpy()
    own, a, b = np.flatnonzero(~is_outer), [], []
    if len(own):
        groups = groups_for(sizes)
        data = np.stack([point(s, groups) for s in sets])
        tree = CountTree(data[own], sizes[own])
        for i in np.flatnonzero(is_outer):
            known: set[int] = set()
            for k in tree.reach(data[i], int(sizes[i]), root[own] != root[i]):
                j = own[k]
                if int(root[j]) not in known and links(common(sets[i], sets[j]), int(sizes[i]), int(sizes[j])):
                    known.add(int(root[j]))
                    a.append(int(node[i]))
                    b.append(int(node[j]))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def joined(current: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` after the parts at both ends of each edge became one."""
    ends = [current.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    edges = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    return replaced(current, components(edges, "joined"))


def stragglers_edges(members: DataFrame, current: DataFrame, leaf: int) -> DataFrame:
    """Links between different current parts of candidate components of several leaves.

    Every set outside its candidate component's largest part meets all others,
    block by block: as a point first; the sets that pass the bound in a block
    meet there as sets.
    """
    size = 4 * leaf

    def points(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                own = [np.frombuffer(h, "<u8") for h in batch.column("hashes").to_pylist()]
                found = [point(s, 256) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("node", "candidate", "root")), pa.array(map(len, own), pa.int64()), pa.array(
                        [x.astype("<u1" if x.max() < 256 else "<u4").tobytes() for x in found], pa.binary())],
                    names=["node", "candidate", "root", "n", "counts"])

        return rows.mapInArrow(run, "node long, candidate long, root long, n long, counts binary")

    part = written_once(points(members.select("node", "candidate", "hashes").join(current, "node").select(
        "node", "candidate", "root", "hashes")), "points")
    main = largest_parts(part)
    part = part.join(main, "candidate")
    columns = ["candidate", "leaf", "chunk", "node", "root", "n", "counts"]
    inner = part.withColumn("leaf", block("total", size)).withColumn("chunk", numbers("outside", size))
    outer = part.filter("root <> main").withColumn("chunk", block("outside", size)).withColumn("leaf", numbers("total", size))

    def bound(rows: pa.Table) -> pa.Table:
        data = np.stack([np.frombuffer(h, f"<u{len(h) // 256}") for h in rows.column("counts").to_pylist()]).astype(np.int64)
        n = rows.column("n").to_numpy()
        is_outer = rows.column("outer").to_numpy(zero_copy_only=False)
        root = rows.column("root").to_numpy()
        own, met = np.flatnonzero(~is_outer), np.zeros(len(n), bool)
        if len(own):
            tree = CountTree(data[own], n[own])
            for i in np.flatnonzero(is_outer):
                hit = tree.reach(data[i], int(n[i]), root[own] != root[i])
                met[own[hit]] = True
                met[i] = len(hit) > 0
        return rows.select(["candidate", "leaf", "chunk", "node", "root", "outer"]).filter(pa.array(met))

    met = written_once(inner.select(*columns, F.lit(False).alias("outer")).unionByName(
        outer.select(*columns, F.lit(True).alias("outer"))).groupBy("candidate", "leaf", "chunk").applyInArrow(
        bound, "candidate long, leaf long, chunk long, node long, root long, outer boolean"), "met")
    return members.select("node", "hashes").join(met, "node").groupBy(
        "candidate", "leaf", "chunk").applyInArrow(link_outer, EDGES)


def link_sets(docs: DataFrame, wanted: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``node, root`` of all sets in ``wanted``, which has ``node, candidate``."""
    wanted = written_once(dealt(wanted, leaf), "dealt")
    members = member_sets(docs, wanted, wanted.count())
    inside = written_once(members.select("node", "hashes", "candidate", "leaf").groupBy(
        "candidate", "leaf").applyInArrow(join_leaf, EDGES), "links")
    current = inside.select(F.col("b").alias("node"), F.col("a").alias("root"))
    several = members.filter("leaves > 1")
    if several.isEmpty():
        return current
    # pivots: the least set of each leaf's parts, joined as long as that lessens them
    pivots = several.select("node", "candidate").join(
        inside.select(F.col("a").alias("node")).distinct(), "node")
    edges, before = None, None
    while True:
        pivots = written_once(dealt(pivots, leaf), "pivots")
        n = pivots.count()
        if before is not None and 2 * n > before:
            break
        sets = several.select("node", "hashes").join(pivots, "node")
        more = written_once(sets.groupBy("candidate", "leaf").applyInArrow(join_leaf, EDGES), "pivot-links")
        edges = more if edges is None else edges.unionByName(more)
        if pivots.filter("leaves > 1").isEmpty():
            break
        before = n
        pivots = pivots.select("node", "candidate").join(more.select(F.col("a").alias("node")).distinct(), "node")
    current = written_once(replaced(current, components(edges, "joined")), "parts")
    more = written_once(stragglers_edges(several, current, leaf), "straggler-links")
    return current if more.isEmpty() else joined(current, more)


def replaced(current: DataFrame, joined: DataFrame) -> DataFrame:
    """``node, root`` with roots that were joined to others replaced by theirs."""
    joined = joined.select(F.col("node").alias("old"), F.col("root").alias("new"))
    return current.join(joined, current["root"] == joined["old"], "left").select(
        "node", F.coalesce("new", "root").alias("root"))


def candidates(docs: DataFrame, frequent: dict[int, int], shingles: int) -> DataFrame:
    """``node, candidate`` of the sets that may link; single ones may be among them."""
    spark = docs.sparkSession
    hot = np.array(sorted(frequent), np.uint64)
    passed = written_once(may_link(docs, hot, slices_for(shingles // 2)), "may-link")
    size = passed.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("hashes")).first()
    within = spark.sparkContext.broadcast(wanted_bits(passed, size["sets"]))
    wanted_at = scratch_path(spark, "wanted")
    with scratch_scope(spark):
        found = components(candidate_edges(docs, within, frequent, slices_for(size["hashes"] or 0)), "candidates")
        # neither vertices of frequent hashes nor sets that only share a bit are wanted
        found.join(passed.select("node"), "node").withColumnRenamed("root", "candidate").write.parquet(wanted_at)
    return spark.read.schema("node long, candidate long").parquet(wanted_at)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          leaf: int = LEAF, frequent_share: float = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    spark, docs = docs.sparkSession, texts(docs, id_col, text_col)
    with shuffles_dropped(spark):
        sets = scan_sets(docs)
        rows = sets.filter("n IS NOT NULL").select("doc_id", "n", "node")
        size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).first()
        # at most 2 / share hashes for each hash of an average set, whatever the input
        reports = sets.filter("token IS NOT NULL").groupBy("token").agg(F.sum("held").alias("held")).filter(
            F.col("held") >= max(64, frequent_share / 2 * size["rows"]))
        frequent = {r["token"] & 0xFFFFFFFFFFFFFFFF: r["held"] for r in reports.collect()}
        named_at = scratch_path(spark, "named")
        with scratch_scope(spark):
            wanted = candidates(docs, frequent, int(size["shingles"] or 0))
            linked = link_sets(docs, wanted, leaf)
            # per distinct set first; both sides of each join are written or plain, so that Spark can split a large component
            placed = written_once(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(
                linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
            least = written_once(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
            placed.join(least, "root").select("node", "component_id").write.parquet(named_at)
        named = spark.read.schema("node long, component_id long").parquet(named_at)
    out = rows.filter("node IS NOT NULL").join(named, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("node IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


@query("op4_ngram_jaccard_join")
def op4(spark, sf_dir):
    return similarity_components(table(spark, sf_dir, "documents"))
