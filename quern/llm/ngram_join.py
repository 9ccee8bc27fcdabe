"""Self-join of documents on the Jaccard similarity of their word shingles (operator 3).

Size-banded tiles: a document of n shingles belongs to the tile of its power of two, and to the
one below if it is within a quarter of it, so that any two linked documents meet in a
tile. Within a tile, the shingle space is cut by hash into m parts; a document's signature
in a part is the hash of its shingles there, and documents that agree in a part meet in a
*cell*. Linked documents differ in at most n / 4 shingles, n being the smaller size, so in at most as many parts; m is such that
more parts than that are not empty, and in one of them at least both agree: no link is missed. A document
whose shingles leave too many parts empty (by chance, as good as never) is held against every document of a size that
it may be linked with. Below 64 shingles the cells are prefix tokens, which miss nothing either.

Work stays far from all pairs of a cell. Documents with equal sets are one node. Cells of the same
nodes count once. Every node of a cell is first compared with the cell's smallest node (a star; by parities before texts are moved). Cells whose nodes are then in
one component need nothing more. In the others, each node outside the largest component is held
against all nodes of other components by parities of 4 to 8 bits a shingle, whose differences bound
the overlap from above; only what these leave is intersected exactly.
Texts are not stored; those of pairs that parities leave are read again from the documents.
The first round takes, of each tile, a forest of the most promising pairs between components, which meet with their
texts and with bitmaps of 8 to 16 bits a shingle. The last one takes all pairs that are still apart, of the cells where the first found any, so components are those of all links. As they may be as many as
the square of a group's size, they are never rows: a node has one row a tile with the list of its partners, and lists of
the same nodes are put together to groups that hold each text once and yield links only.

Null or wordless text: no shingles, linked with nothing. Rows without doc_id take part, but
a component of only such rows has a null id. Repeated rows are kept as they are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.filters import BitFilter
from quern.llm.graphs import components
from quern.llm.textual import batch_shingles, batches, mix
from quern.storage import brief_shuffles, scratch, stored

#: Standard deviations by which a document may have more empty parts than it has on average.
SLACK = 7.0
#: Documents of fewer shingles use prefix tokens.
SMALL = 64
#: Postings that a map task holds before it sends them on, and the bytes of text whose postings a bucket gets on average (a word makes less than one posting of 16 bytes).
HELD, BUCKET = 250_000, 8 << 20
#: Nodes of a tile's side, and shingles of the texts that are intersected at once.
BLOCK, GROUP = 1024, 1 << 20
#: Whether a round takes forests of pairs; the last one takes all.
ROUNDS = (True, False)


@functools.cache
def parts(band: int) -> int:
    """Parts of the tile with sizes from 2**band: the fewest that, less the empty ones and ``SLACK``, are more than a quarter of the largest size."""
    n = 2 ** (band + 1)
    m = n // 4 + 2
    while True:
        one = math.exp(-n / m)  # the chance that a part is empty
        if m - m * one - SLACK * math.sqrt(m * one * (1 - (1 + n / m) * one)) > n / 4:
            return m
        m += max(1, m // 256)


def tiles(n: int) -> list[int]:
    band = n.bit_length() - 1
    return [band, band - 1] if band and 4 * n < 5 * 2**band else [band]


def signatures(s: np.ndarray, parts: Callable[[int], int] = parts) -> tuple[np.ndarray, bool]:
    """Cell keys of a document with the sorted shingles ``s``, and whether all larger ones that are linked with it have one of them."""
    n, out, meets = len(s), [], True
    with np.errstate(over="ignore"):
        for band in tiles(n):
            if 2 ** (band + 1) <= SMALL:  # prefix tokens in hash order
                out.append(mix(s[: n // 5 + 1] + np.uint64(band + 1) * np.uint64(0xC2B2AE3D27D4EB4F)))
                continue
            m = parts(band)
            # s is sorted, so equal leading bits are neighbours: parts are ranges
            part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sums = np.add.reduceat(mix(s ^ np.uint64(0x94D049BB133111EB)), first)
            out.append(mix(sums + mix(part[first] * np.uint64(64) + np.uint64(band))))
            if band == n.bit_length() - 1:
                meets = len(first) > n // 4
    return np.concatenate(out), meets


def bits(n: int) -> int:
    return max(64, 1 << (8 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> bytes:
    b = np.zeros(bits(len(s)), bool)
    b[(mix(s) & np.uint64(len(b) - 1)).astype("i8")] = True
    return np.packbits(b, bitorder="little").tobytes()


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each of 4 to 8 bits a shingle: sets differ in at least as many shingles as bits."""
    w = max(256, 4 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s) & np.uint64(w - 1)).astype("i8"), minlength=w) & 1 == 1, bitorder="little").tobytes()


def node_of(s: np.ndarray) -> int:
    """A 64-bit fingerprint of the set."""
    with np.errstate(over="ignore"):
        total = mix(s + np.uint64(0x589965CC75374CC3)).sum(dtype="u8", keepdims=True)
        return int(mix(total + np.uint64(len(s)) * np.uint64(0xD6E8FEB86659FD93)).view("i8")[0])


FEATURES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("parity", pa.binary())])


def _features(it: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Every row's set, without its text; the first row of a task whose set may be in a cell with others also carries its parity."""
    seen: set[int] = set()
    for batch in it:
        sets = batch_shingles(batch["text"])
        nodes = np.array([node_of(s) if len(s) else 0 for s in sets], "i8")
        own = []
        for k, (v, may) in enumerate(zip(nodes.tolist(), shared.value.may_have(nodes).tolist(), strict=True)):
            new = may and len(sets[k]) > 0 and v not in seen
            own.append(new)
            if new:
                seen.add(v)
        if len(seen) > HELD:
            seen = set()
        columns = [
            batch["doc_id"], batch["h"], [len(s) for s in sets], [v if len(s) else None for v, s in zip(nodes.tolist(), sets, strict=True)],
            [parity(s) if keep else None for s, keep in zip(sets, own, strict=True)],
        ]
        yield pa.record_batch([pa.array(c, t.type) if isinstance(c, list) else c for c, t in zip(columns, FEATURES, strict=True)], schema=FEATURES)


TEXTS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary()), ("text", pa.string())])


def _fetch(it: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts whose hash and node may be among those of the shared filters, each node once a task or so."""
    hashes, nodes = shared.value
    seen: set[int] = set()
    for batch in it:
        batch = batch.filter(pa.array(hashes.may_have(batch["h"].to_numpy())))
        sets = batch_shingles(batch["text"])
        own = np.array([node_of(s) if len(s) else 0 for s in sets], "i8")
        rows = []
        for k, (v, may) in enumerate(zip(own.tolist(), nodes.may_have(own).tolist(), strict=True)):
            if may and len(sets[k]) and v not in seen:
                seen.add(v)
                rows.append(k)
        if len(seen) > HELD:
            seen = set()
        if rows:
            columns = [own[rows], [len(sets[k]) for k in rows], [bitmap(sets[k]) for k in rows], batch["text"].take(pa.array(rows, pa.int64()))]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, TEXTS, strict=True)], schema=TEXTS)


PACKED = pa.schema([("bucket", pa.int32()), ("meeting", pa.bool_()), ("cells", pa.binary()), ("nodes", pa.binary())])


def _send(cells: np.ndarray, nodes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of a map task as one row a bucket.

    A cell that already has several nodes here is marked as met: all its nodes go on as they
    are, to any bucket, and only the smallest is sent to the cell's own bucket, so that a bucket
    gets no more of a cell than there are tasks.
    """
    order = np.lexsort((nodes, cells))
    cells, nodes = cells[order], nodes[order]
    keep = np.append(True, (cells[1:] != cells[:-1]) | (nodes[1:] != nodes[:-1]))
    cells, nodes = cells[keep], nodes[keep]
    first = np.append(True, cells[1:] != cells[:-1])
    several = ~first
    several[:-1] |= several[1:]
    for meeting, mask in ((False, first), (True, several)):
        c, v = cells[mask], nodes[mask]
        to = ((mix(c if not meeting else v.view("u8")) >> np.uint64(33)) % np.uint64(buckets)).astype("i4")
        order = np.argsort(to, kind="stable")
        c, v, to = c[order], v[order], to[order]
        edge = np.searchsorted(to, np.arange(buckets + 1))
        rows = [k for k in range(buckets) if edge[k] < edge[k + 1]]
        for k in rows:
            span = slice(edge[k], edge[k + 1])
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([meeting]), pa.array([c[span].tobytes()], pa.binary()), pa.array([v[span].tobytes()], pa.binary())], schema=PACKED)


#: The bucket of documents (size as cell, node) that may not meet all that they are linked with.
SHORT = -1


def _postings(it: Iterator[pa.RecordBatch], buckets: int, parts: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    held, size, seen = [], 0, set()
    for batch in it:
        for s in batch_shingles(batch["text"]):
            if len(s) and (v := node_of(s)) not in seen:
                seen.add(v)
                c, meets = signatures(s, parts)
                if not meets:
                    yield pa.record_batch([pa.array([SHORT], pa.int32()), pa.array([False]), *(pa.array([np.array([x], "i8").tobytes()], pa.binary()) for x in (len(s), v))], schema=PACKED)
                held.append((c, np.full(len(c), v, "i8")))
                size += len(c)
                if size >= HELD:
                    yield from _send(*map(np.concatenate, zip(*held, strict=True)), buckets)
                    held, size, seen = [], 0, set()
    if held:
        yield from _send(*map(np.concatenate, zip(*held, strict=True)), buckets)


def _rest(it: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """A cell of its own for every document and each of the shared (sizes in order, nodes) that is no larger and may be linked with it."""
    sizes, nodes = shared.value
    for batch in it:
        for s in batch_shingles(batch["text"]):
            lo, hi = np.searchsorted(sizes, -(-4 * len(s) // 5), "left"), np.searchsorted(sizes, len(s), "right")
            if len(s) and lo < hi:
                v = np.array([node_of(s)], "i8")
                other = nodes[lo:hi][nodes[lo:hi] != v]
                cells = mix(other.view("u8") ^ mix(v.view("u8"))).view("i8")
                yield pa.record_batch([pa.array(np.tile(cells, 2)), pa.array(np.append(other, np.repeat(v, len(other)))), pa.array(np.zeros(2 * len(other), bool))], schema=MEMBERS)


MEMBERS = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("short", pa.bool_())])


def _meet(table: pa.Table) -> pa.Table:
    """The postings of a bucket whose cell has several nodes, or had several in a map task; all of the bucket ``SHORT``."""
    if table.num_rows and table["bucket"][0].as_py() == SHORT:
        own = [np.frombuffer(b"".join(table[c].to_pylist()), "i8") for c in ("cells", "nodes")]
        return pa.table([pa.array(own[0]), pa.array(own[1]), pa.array(np.ones(len(own[0]), bool))], schema=MEMBERS)
    sent = {False: ([], []), True: ([], [])}
    for meeting, c, v in zip(table["meeting"].to_pylist(), table["cells"], table["nodes"], strict=True):
        sent[meeting][0].append(np.frombuffer(c.as_buffer(), "u8"))
        sent[meeting][1].append(np.frombuffer(v.as_buffer(), "i8"))
    done = [np.concatenate(x) if x else np.zeros(0, "i8") for x in sent[True]]
    if sent[False][0]:
        cells, nodes = map(np.concatenate, sent[False])
        order = np.lexsort((nodes, cells))
        cells, nodes = cells[order], nodes[order]
        keep = np.append(True, (cells[1:] != cells[:-1]) | (nodes[1:] != nodes[:-1]))
        cells, nodes = cells[keep], nodes[keep]
        several = np.append(False, cells[1:] == cells[:-1])
        several[:-1] |= several[1:]
        done = [np.concatenate([done[0].view("u8"), cells[several]]), np.concatenate([done[1], nodes[several]])]
    return pa.table([pa.array(done[0].view("i8")), pa.array(done[1]), pa.array(np.zeros(len(done[0]), bool))], schema=MEMBERS)


def linked(a: int, b: int | np.ndarray, common: int | np.ndarray) -> bool | np.ndarray:
    return 100 * common >= 80 * (a + b - common)


def _fold(b: np.ndarray, words: int) -> np.ndarray:
    while len(b) > words:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def _fold_parity(b: np.ndarray, words: int) -> np.ndarray:
    while len(b) > words:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def parity_bound(n: int, b: np.ndarray, ns: np.ndarray, bs: np.ndarray) -> np.ndarray:
    """No less than the overlap of a set with each of others, by their parities."""
    differ = np.bitwise_count(b ^ bs).sum(1, dtype="i8")
    return np.minimum(np.minimum(n, ns), (n + ns - differ) // 2)


def bound(n: int, b: np.ndarray, ns: np.ndarray, bs: np.ndarray) -> np.ndarray:
    """No less than the overlap of a set with each of others, by bits that only one side has."""
    own = np.bitwise_count(b & ~bs).sum(1, dtype="i8")
    other = np.bitwise_count(bs & ~b).sum(1, dtype="i8")
    return np.minimum(n - own, ns - other)


VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are linked: bitmaps first, then the exact intersection of sorted arrays."""
    last, kept = None, None
    for batch in it:
        hit = []
        na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
        for i in range(len(na)):
            x, y = np.frombuffer(batch["ba"][i].as_buffer(), "u8"), np.frombuffer(batch["bb"][i].as_buffer(), "u8")
            w = min(len(x), len(y))
            if 5 * min(na[i], nb[i]) >= 4 * max(na[i], nb[i]) and linked(na[i], nb[i], bound(na[i], _fold(x, w), nb[i : i + 1], _fold(y, w)[None])[0]):
                hit.append(i)
        out = []
        sets = dict(zip(hit, batch_shingles(batch["tb"].take(pa.array(hit, pa.int64()))), strict=True)) if hit else {}
        for i in hit:
            a = batch["a"][i].as_py()
            if a != last:
                last, kept = a, batch_shingles(batch["ta"].slice(i, 1))[0]
            both = np.concatenate([kept, sets[i]])
            both.sort()
            if linked(len(kept), len(sets[i]), int((both[1:] == both[:-1]).sum())):
                out.append(i)
        yield batch.select(["a", "b"]).take(pa.array(out, pa.int64()))


CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64())])


def _forest(a: np.ndarray, b: np.ndarray, promise: np.ndarray) -> np.ndarray:
    """Places of the pairs, the most promising first, that join components not yet joined by earlier ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for k, x, y in zip((order := np.argsort(-promise, kind="stable")).tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            parent[p] = q
            out.append(k)
    return np.array(out, "i8")


NEAR = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("others", pa.binary())])


def _tile(table: pa.Table, forest: bool) -> pa.Table:
    """Pairs of a bucket's tiles that the parities allow, of nodes in different components.

    forest: as rows (a, b, null), only as many of each tile as join its components, if all were linked, and (null, null, cell) of the cells that
    have any; else all, as lists by node.
    """
    frame = table.combine_chunks()
    cells = [frame[c].to_numpy() for c in ("cell", "i", "j")]
    role, node, comp, n, main, key = (frame[c].to_numpy() for c in ("role", "node", "comp", "n", "main", "key"))
    maps = frame["parity"].chunk(0) if frame.num_rows else None
    order = np.lexsort((node, role, *cells[::-1]))
    change = np.any([k[order][1:] != k[order][:-1] for k in cells], axis=0) if len(order) else np.zeros(0, bool)
    done, near, open_ = [np.zeros((0, 2), "i8")], [], set()
    for own in np.split(order, np.flatnonzero(change) + 1):
        left, right = np.flatnonzero(role[own] != 1), np.flatnonzero(role[own] != 0)
        if not len(left) or not len(right):
            continue
        raw = [np.frombuffer(maps[k].as_buffer(), "u8") for k in own.tolist()]
        w = min(map(len, raw))
        fine = np.stack([_fold_parity(x, w) for x in raw])
        coarse = np.bitwise_xor.reduce(fine.reshape(len(own), 4, w // 4), axis=1)
        bs, wide, to = fine[right], coarse[right], own[right]
        ns, cs, vs = n[to], comp[to], node[to]
        pairs = []
        for x in left.tolist():
            k = own[x]
            top = parity_bound(n[k], coarse[x], ns, wide)
            may = (cs != comp[k]) & (5 * np.minimum(ns, n[k]) >= 4 * np.maximum(ns, n[k])) & (100 * top >= 80 * (ns + n[k] - top))
            if not forest:  # pairs beside the main component are met from both sides
                may &= (cs == main[k]) | (vs > node[k])
            ok = np.flatnonzero(may)
            if len(ok):
                top = parity_bound(n[k], fine[x], ns[ok], bs[ok])
                may = 100 * top >= 80 * (ns[ok] + n[k] - top)
                ok, top = ok[may], top[may]
            if len(ok) and forest:
                pairs.append((np.full(len(ok), node[k]), vs[ok], np.full(len(ok), comp[k]), cs[ok], top / (ns[ok] + n[k] - top)))
            elif len(ok):
                near.append((key[k], node[k], n[k], vs[ok].tobytes()))
        if pairs:
            a, b, ca, cb, promise = map(np.concatenate, zip(*pairs, strict=True))
            pick = _forest(ca, cb, promise)
            done.append(np.stack([np.minimum(a, b)[pick], np.maximum(a, b)[pick]], 1))
            open_.add(int(cells[0][own[0]]))
    if not forest:
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*near, strict=True) if near else [[]] * 4, NEAR, strict=True)], schema=NEAR)
    out = np.unique(np.concatenate(done), axis=0)
    some, none = pa.array(sorted(open_), pa.int64()), lambda k: pa.nulls(k, pa.int64())
    return pa.table([pa.concat_arrays([pa.array(out[:, c].copy()), none(len(some))]) for c in (0, 1)] + [pa.concat_arrays([none(len(out)), some])], schema=CANDIDATES)


GATHERED = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("others", pa.binary())])


def _runs(*keys: np.ndarray) -> list[np.ndarray]:
    """Places of equal keys, in the keys' order."""
    order = np.lexsort(keys[::-1])
    change = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return np.split(order, np.flatnonzero(change) + 1) if len(order) else []


def _gather(table: pa.Table, limit: int) -> pa.Table:
    """Lists of a bucket, each pair of a key once, in groups of nodes with about ``limit`` shingles; a node has one row in a group."""
    key, a, n = (table[c].to_numpy() for c in ("key", "a", "n"))
    lists = [np.frombuffer(x.as_buffer(), "i8") for x in table["others"]]
    rows = []
    last, at, chunk, seen, weight = None, 0, {}, {}, 0

    def flush() -> None:
        g = int(mix(mix(np.array([last], "i8").view("u8")) + np.uint64(at)).view("i8")[0])
        rows.extend((g, v, size, chunk.get(v)) for v, size in seen.items())

    with np.errstate(over="ignore"):
        for same in _runs(key, a):
            k = same[0]
            others = np.unique(np.concatenate([lists[x] for x in same.tolist()]))
            size, here = int(n[k]), [int(a[k]), *others.tolist()]
            more = size * sum(v not in seen for v in here)
            if last != key[k] or weight + more > limit:
                if seen:
                    flush()
                at = at + 1 if last == key[k] else 0
                last, chunk, seen, weight, more = key[k], {}, {}, 0, size * len(here)
            weight += more
            chunk[here[0]] = others.tobytes()
            for v in here:
                seen.setdefault(v, size)
        if seen:
            flush()
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, GATHERED, strict=True)], schema=GATHERED)


def _intersect(table: pa.Table) -> pa.Table:
    """Of each group of a bucket, as many of the linked pairs as join its nodes."""
    g, node = table["g"].to_numpy(), table["node"].to_numpy()
    a, b = [], []
    for own in _runs(g):
        sets = dict(zip(node[own].tolist(), batch_shingles(table["text"].take(pa.array(own))), strict=True))
        pairs: tuple[list[int], list[int]] = ([], [])
        for v, others in zip(node[own].tolist(), table["others"].take(pa.array(own)), strict=True):
            if not others.is_valid:
                continue
            s, others = sets[v], np.frombuffer(others.as_buffer(), "i8").tolist()
            size = np.array([len(sets[x]) for x in others])
            all_ = np.concatenate([sets[x] for x in others])
            common = np.add.reduceat(s[np.minimum(np.searchsorted(s, all_), len(s) - 1)] == all_, np.append(0, size.cumsum()[:-1]), dtype="i8")
            for k in np.flatnonzero(linked(len(s), size, common)).tolist():
                pairs[0].append(v)
                pairs[1].append(others[k])
        x, y = (np.array(p, "i8") for p in pairs)
        pick = _forest(x, y, np.zeros(len(x)))
        a.append(np.minimum(x, y)[pick])
        b.append(np.maximum(x, y)[pick])
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, "i8")) for c in (a, b)], schema=VERIFIED)


def _may_link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that sizes and parities allow."""
    for batch in it:
        na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
        near = np.flatnonzero(5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
        out = []
        for i in near.tolist():
            x, y = np.frombuffer(batch["pa"][i].as_buffer(), "u8"), np.frombuffer(batch["pb"][i].as_buffer(), "u8")
            w = min(len(x), len(y))
            if linked(na[i], nb[i], parity_bound(na[i], _fold_parity(x, w), nb[i : i + 1], _fold_parity(y, w)[None])[0]):
                out.append(i)
        yield batch.select(["a", "b"]).take(pa.array(out, pa.int64()))


def _allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked by their sizes and parities; no text is moved."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_may_link, "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, bitmap, text) of the nodes of ``wanted``, and by chance of a few others; read from ``docs`` (h, text), so that no other text is moved or stored.

    classes: (node, rank) with the hash ``h`` of one of the node's texts in rank.
    """
    spark = docs.sparkSession
    keys = stored(wanted.distinct().join(classes, "node").select("node", "rank.h"), "wanted")
    shared = spark.sparkContext.broadcast((BitFilter.of(keys, "h"), BitFilter.of(keys, "node")))
    return docs.select("h", "text").mapInArrow(lambda it: _fetch(it, shared), "node long, n long, bitmap binary, text string").dropDuplicates(["node"])


def _linked_pairs(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored pairs (a, b) that are linked."""
    nodes = texts(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bitmap").alias(f"b{k}"), F.col("text").alias(f"t{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verify, "a long, b long")


def _apart(members: DataFrame, comp: DataFrame, nodes: DataFrame, forest: bool) -> DataFrame:
    """Pairs of nodes that share a cell, are in different components, and may be linked; see ``_tile``. Stars have decided all pairs of a cell's centre."""
    spark = members.sparkSession
    m = members.filter("node != centre").join(comp.select("node", F.col("comp.node").alias("comp")), "node", "left").select("cell", "node", F.coalesce("comp", "node").alias("comp"))
    m = stored(m, "cells")
    # the component of the most nodes of a cell; counts are made before rows meet
    sizes = m.groupBy("cell", "comp").agg(F.count("*").alias("k"))
    info = sizes.groupBy("cell").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"), F.count("*").alias("comps"))
    info = info.filter("comps > 1").select("cell", F.col("top.comp").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("mb"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("rb"))
    m = stored(m.join(info, "cell"), "mixed")
    spread = lambda seed, of: F.pmod(F.hash("node", F.lit(seed)), F.col(of))
    # a cell of one tile gets each node once, for both sides
    single = F.col("mb") * F.col("rb") == 1
    role = F.when(single & (F.col("comp") != F.col("main")), 2).otherwise(1)
    key = F.xxhash64("main", "i", "j", "mb", "rb").alias("key")
    member = m.select("cell", "node", "comp", "main", "mb", "rb", role.alias("role"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("i"), spread(1, "mb").alias("j"))
    rest = m.filter((F.col("comp") != F.col("main")) & ~single).select("cell", "node", "comp", "main", "mb", "rb", F.lit(0).alias("role"), spread(2, "rb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"))
    rows = member.union(rest).withColumn("key", key).drop("mb", "rb").join(nodes.select("node", "n", "parity"), "node")
    total = m.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000)
    rows = rows.withColumn("bucket", F.pmod(F.hash("cell", "i", "j"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(lambda t: _tile(t, forest), "a long, b long, cell long" if forest else "key long, a long, n long, others binary")


def _linked_lists(near: DataFrame, texts: Callable[[DataFrame], DataFrame], limit: int = GROUP) -> DataFrame:
    """Of the pairs in the stored lists ``near``, linked ones that join all nodes that linked ones join."""
    spark = near.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, math.ceil(near.agg(F.sum(F.octet_length("others"))).first()[0] / BUCKET))
    groups = near.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: _gather(t, limit), "g long, node long, n long, others binary")
    groups = stored(groups, "groups")
    parts = max(width, math.ceil(groups.agg(F.sum("n")).first()[0] / (2 * GROUP)))
    rows = groups.select("g", "node", "others").join(texts(groups.select("node")).select("node", "text"), "node")
    return rows.groupBy(F.pmod("g", F.lit(parts)).alias("bucket")).applyInArrow(lambda t: _intersect(t), "a long, b long")


def _members(docs: DataFrame, parts: Callable[[int], int]) -> DataFrame:
    """Stored (cell, node) of the cells with several nodes; of cells with the same nodes, one."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BUCKET))
    packed = docs.select("text").mapInArrow(functools.partial(_postings, buckets=buckets, parts=parts), "bucket int, meeting boolean, cells binary, nodes binary")
    schema = "cell long, node long, short boolean"
    every = stored(packed.groupBy("bucket").applyInArrow(lambda t: _meet(t), schema).distinct(), "members")
    short = every.filter("short").orderBy("cell", "node").collect()  # sizes and nodes, in all likelihood none
    every = every.filter("not short").drop("short")
    if short:
        shared = spark.sparkContext.broadcast(tuple(np.array([r[c] for r in short], "i8") for c in ("cell", "node")))
        rest = docs.select("text").mapInArrow(lambda it: _rest(it, shared), schema).drop("short").distinct()
        every = stored(every.union(rest), "members")
    # two 64-bit sums, the count and the least tell sets of nodes apart
    alike = every.groupBy("cell").agg(F.count("*").alias("k"), F.min("node").alias("centre"), *[F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)])
    cells = alike.filter("k > 1").groupBy("k", "centre", "s1", "s2").agg(F.min("cell").alias("cell")).select("cell", "centre")
    return stored(every.join(cells, "cell"), "cells", outlive=True)


@scratch()
@brief_shuffles
def _rows(docs: DataFrame, parts: Callable[[int], int] = parts) -> DataFrame:
    """Stored (doc_id, h, n_shingles, first) for every row of ``docs`` (doc_id, h, text).

    first: (none, doc_id, h) of the least row of the row's component, those without doc_id last; null for texts without words.
    """
    spark = docs.sparkSession
    members = _members(docs, parts)
    involved = stored(members.select("node").distinct(), "involved")
    shared = spark.sparkContext.broadcast(BitFilter.of(involved, "node"))
    features = stored(docs.select("doc_id", "h", "text").mapInArrow(lambda it: _features(it, shared), "doc_id long, h long, n_shingles long, node long, parity binary"), "features")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = stored(features.filter("node is not null").groupBy("node").agg(F.min(rank).alias("rank")), "classes")
    carried = features.filter("parity is not null").select("node", F.col("n_shingles").alias("n"), "parity")
    nodes = stored(carried.join(involved, "node", "left_semi").dropDuplicates(["node"]), "nodes")

    texts = functools.partial(_texts, docs, classes)
    star = members.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_linked_pairs(stored(_allowed(star, nodes), "may-link"), texts), "stars")
    comp = components(links, classes)
    for forest in ROUNDS:
        found = _apart(members, comp, nodes, forest)
        found = stored(found.distinct() if forest else found, "pairs")
        if not found.limit(1).count():
            break
        if forest:  # no pair of the other cells may be linked
            members = members.join(found.filter("cell is not null").select("cell"), "cell", "left_semi")
            found = found.filter("a is not null").select("a", "b")
        links = stored(links.union(_linked_pairs(found, texts) if forest else _linked_lists(found, texts)), "links")
        comp = components(links, classes)
    by_node = stored(classes.join(comp, "node", "left").select("node", F.coalesce("comp.rank", "rank").alias("first")), "firsts")
    return stored(features.select("doc_id", "h", "n_shingles", "node").join(by_node, "node", "left").drop("node"), "rows", outlive=True)


def jaccard_components(docs: DataFrame, parts: Callable[[int], int] = parts) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text); see the module. parts: of each tile, any number gives the same rows."""
    batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")), parts)
    return rows.select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


@scratch()
def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, all columns: one with the smallest doc_id (null last); all rows without words.

    Rows are told apart by doc_id and text, as a doc_id may be null, repeated, or stand by several texts; of rows that are alike
    in both, any one stays. Rows that a bit filter shows to be neither dropped nor repeated stay where they are; only the others
    are shuffled, after rows that are alike were put together in each task.
    """
    spark, schema, names = docs.sparkSession, docs.schema, docs.columns
    batches(spark)
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    rows = _rows(docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))).filter("first is not null")
    key = lambda d, h: (F.coalesce(d, F.lit(0)).alias("d"), d.isNull().alias("none"), h.alias("h"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    groups = rows.select(*key(F.col("doc_id"), F.col("h")), (own != F.col("first")).alias("drop")).groupBy("d", "none", "h").agg(F.max("drop").alias("drop"), F.count("*").alias("n"))
    special = stored(groups.filter("drop or n > 1").select("d", "none", "h", "drop", F.xxhash64("d", "none", "h").alias("key")), "special", outlive=True)
    shared = spark.sparkContext.broadcast(BitFilter.of(special, "key"))
    d, none, h = key(doc_id, F.xxhash64(text))
    wordless = F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    keyed = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], F.when(~wordless, F.xxhash64(d, none, h)).alias("key"))
    plain = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])

    def chosen(it: Iterator[pa.RecordBatch], special: bool) -> Iterator[pa.RecordBatch]:
        for b in it:
            has = b["key"].is_valid().to_numpy(zero_copy_only=False)
            may = has & shared.value.may_have(b["key"].fill_null(0).to_numpy())
            yield b.select(plain.names).filter(pa.array(may == special))

    stay = keyed.mapInArrow(lambda it: chosen(it, False), plain)
    others = keyed.mapInArrow(lambda it: chosen(it, True), plain)
    place = {c: f"c{k}" for k, c in enumerate(names)}
    own_id, own_text = F.col(place["doc_id"]).cast("long"), F.col(place["text"]).cast("string")
    once = others.select(*key(own_id, F.xxhash64(own_text)), F.struct("*").alias("row")).groupBy("d", "none", "h").agg(F.first("row").alias("row"))
    left = once.join(special.filter("drop").select("d", "none", "h"), ["d", "none", "h"], "left_anti").select("row.*")
    return stay.union(left).toDF(*names)
