"""Near-duplicates by SimHash with anchor-point covering.

Every 64-bit fingerprint lies within distance 3 of exactly one word of the perfect binary Golay code in each of two
23-bit blocks; that pair of code words is its home anchor. If two fingerprints differ in at most d bits, the second
lies within 3 + d of the first one's home, the excess over 3 summed over both blocks. So each fingerprint is sent to
its home and, as a guest, to every anchor with an excess of at most d, and is compared there with those at home.

Near copies of a stated similarity differ in more bits than that. Their SimHash has many blocks, each with its own
anchors, and texts that share one block's home are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import EDGE, U64, components, forest, forget, fresh, map_rows, mix, pieces, record, settle, shuffle_count, texts
from .words import grams, hashes, split

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
CASE = bytes.maketrans(UPPER, LOWER)

# --- fingerprints -------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the bits of the XXH64 (seed 42) of a text's word shingles, repeats included; no words: zero."""
    import xxhash

    w = text.translate(CASE).split()
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), U64, count=n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *keys: str, width: int = 3, text: str = "text") -> DataFrame:
    """The columns `keys` and fp (long) of each row; null text has no words."""
    given = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(x, width) for x in texts(batch.column("__text"))], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=[*keys, "fp"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(given, run, f"{kinds}, fp long")


# --- anchors ------------------------------------------------------------------------------------------------------

#: Fixed value: generator polynomial of the binary Golay code of length 23, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY, LENGTH, RADIUS = 0b101011100011, 23, 3


@lru_cache
def residues() -> np.ndarray:
    """Remainder of x^i by the generator for each bit i of a block."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    return np.array(out, np.int64)


@lru_cache
def cosets(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to 3 + reach, sorted by (syndrome, weight): patterns, excess over 3, and where each syndrome starts."""
    bits, res = 1 << np.arange(LENGTH), residues()
    pattern, weight = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    syndrome = [np.zeros(1, np.int64)]
    for k in range(1, RADIUS + reach + 1):
        at = np.array(list(combinations(range(LENGTH), k)))
        pattern.append(np.bitwise_or.reduce(bits[at], axis=1))
        syndrome.append(np.bitwise_xor.reduce(res[at], axis=1))
        weight.append(np.full(len(at), k))
    p, s, w = map(np.concatenate, (pattern, syndrome, weight))
    order = np.lexsort((w, s))
    return p[order], np.maximum(0, w[order] - RADIUS), np.searchsorted(s[order], np.arange(2049))


def syndromes(block: np.ndarray) -> np.ndarray:
    out = np.zeros(len(block), np.int64)
    for i, r in enumerate(residues()):
        out ^= np.where((block >> i) & 1, r, 0)
    return out


def near_words(block: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of 23-bit blocks, the code words within 3 + reach of each, and their excess over 3."""
    patterns, excess, begin = cosets(reach)
    s = syndromes(block)
    n = begin[s + 1] - begin[s]
    row = np.repeat(np.arange(len(block)), n)
    at = np.arange(len(row)) + np.repeat(begin[s] - np.cumsum(n) + n, n)
    return row, block[row] ^ patterns[at], excess[at]


def anchors(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of fp, their anchors (46 bits) and whether each is the home; the guests' excess is at most `reach`."""
    x = fp.astype(U64)
    blocks = [((x >> U64(shift)) & U64((1 << LENGTH) - 1)).astype(np.int64) for shift in (0, LENGTH)]
    (r0, c0, e0), (r1, c1, e1) = (near_words(b, reach) for b in blocks)
    rows, code, home = [], [], []
    for e in range(reach + 1):  # the first block's excess; the second has what is left
        i = np.flatnonzero(e0 == e)
        keep = np.flatnonzero(e1 <= reach - e)
        m = np.bincount(r1[keep], minlength=len(x))
        starts = np.cumsum(m) - m
        k = m[r0[i]]
        left = np.repeat(i, k)
        right = keep[np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[r0[i]], k)]
        rows.append(r0[left])
        code.append(c0[left] | (c1[right] << LENGTH))
        home.append((e0[left] == 0) & (e1[right] == 0))
    return np.concatenate(rows), np.concatenate(code), np.concatenate(home)


SENT = [("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())]
#: Entries at home that one task holds of an anchor, about, and anchors with more that are broadcast.
HOMES, MOST_BROADCAST = 20_000, 1_000_000


def _send(reach: int):
    """Each fingerprint to its anchors; with a reach of 0 to its home only."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 2_000):
            fp = batch.column(0).slice(at, 2_000).to_numpy()
            row, code, home = anchors(fp.view(U64), reach)
            yield record(SENT, code, fp[row], home)

    return run


def _pairs(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among whole anchors, whose entries lie together: each one at home against all that are there."""
    order = np.lexsort((~home, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(first, len(fp)))
    homes = np.add.reduceat(home.astype(np.int64), first)
    busy = (homes > 0) & (size > 1)
    first, size, homes = first[busy], size[busy], homes[busy]
    h = np.repeat(first - np.cumsum(homes) + homes, homes) + np.arange(homes.sum())
    first, size = np.repeat(first, homes), np.repeat(size, homes)
    a, b, at, total = [fp[:0]], [fp[:0]], 0, np.cumsum(size)
    while at < len(h):  # pairs in blocks of bounded size
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1_000_000, side="right")))
        n = size[at:to]
        x = fp[np.repeat(h[at:to], n)]
        y = fp[np.arange(n.sum()) + np.repeat(first[at:to] - np.cumsum(n) + n, n)]
        near = (x != y) & (np.bitwise_count(x.view(U64) ^ y.view(U64)) <= most)
        u, v = forest(x[near], y[near])
        a.append(u)
        b.append(v)
        at = to
    return forest(np.concatenate(a), np.concatenate(b))


def _compare(most: int):
    """Entries come sorted by anchor, those at home first; what is held at a time is some batches, and of an anchor that goes on only those at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def take(last: bool) -> tuple[np.ndarray, np.ndarray] | None:
            nonlocal held, rows
            anchor, fp, home = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = len(anchor) if last else int(np.searchsorted(anchor, anchor[-1]))
            stay = np.arange(len(anchor)) >= cut
            if not cut and rows >= 1_000_000:  # guests of one anchor: they meet those at home and go
                cut, stay = len(anchor), home
            held, rows = [(anchor[stay], fp[stay], home[stay])], int(stay.sum())
            return _pairs(anchor[:cut], fp[:cut], home[:cut], most) if cut else None

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= 200_000 and (got := take(False)) is not None:
                yield record(EDGE, *got)
        if rows and (got := take(True)) is not None:
            yield record(EDGE, *got)

    return run


def link_fingerprints(fps: DataFrame, most: int = 2, fp: str = "fp", homes: int = HOMES) -> DataFrame:
    """(node, root) of every distinct fingerprint that has another one within `most` bits, directly or through others.

    An anchor that is home to more than about `homes` fingerprints is split: each of them is at home in one part and a
    guest in the others, and guests go to all parts.
    """
    n = shuffle_count(fps.sparkSession)
    # dealt anew, since each row becomes dozens next and a few merged partitions would make them all
    distinct = settle(fps.select(F.col(fp).alias("fp")).filter("fp is not null").distinct()).repartition(n)
    kinds = "anchor long, fp long, home boolean"
    full = map_rows(distinct, _send(0), kinds).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > homes)
    full = settle(full.select(F.col("anchor"), F.ceil(F.col("n") / homes).cast("int").alias("parts")))
    sent, many = map_rows(distinct, _send(most), kinds), full.count()
    if many:
        sent = sent.join(F.broadcast(full) if many <= MOST_BROADCAST else full, "anchor", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        sent = sent.withColumn("home", F.col("home") & (F.col("part") == F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))))
        sent = sent.select(F.xxhash64("anchor", "part").alias("anchor"), "fp", "home")
    dealt = sent.repartition(n, "anchor").sortWithinPartitions("anchor", F.desc("home"))
    return components(dealt.mapInArrow(_compare(most), "a long, b long"))


def simhash_groups(docs: DataFrame, width: int = 3, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fp and component_id, the least key reachable by links of at most `most` bits.

    Null and empty texts have fingerprint zero, linked like any other. Rows with equal fingerprints are one class;
    classes, not rows, are compared. A null key is never a component_id unless the whole component has null keys.
    Extra columns are ignored; an empty table gives an empty result.
    """
    fps = settle(fingerprints(docs, key, width=width, text=text).withColumnRenamed(key, "__key"))
    classes = fps.groupBy("fp").agg(F.min("__key").alias("least"))
    roots = link_fingerprints(fps, most).withColumnRenamed("node", "fp")
    of = settle(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("__key").alias(key), "fp", "component_id")


# --- near copies of a stated similarity ---------------------------------------------------------------------------

#: Blocks of the sketch at whose anchors near copies meet, and its first bits, which drop far pairs there.
BLOCKS, SKETCH = 80, 128
#: Entries of an anchor, and shingles of the texts that are compared with each other, that one task holds, about.
MOST_HELD, WEIGHT = 1_000_000, 1 << 19
#: Sets of fewer shingles have a wider bound, since single shingles turn their majorities.
SMALL = 10


def bit_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the values h have each of the 64 bits, for rows that begin at `first` (none is empty)."""
    size = np.diff(np.append(first, len(h)))
    parts = -(-size // 255)  # sums of up to 255 values fit into the bytes of a word
    begin = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    row = np.cumsum(parts) - parts
    out = np.empty((len(first), 64), np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> U64(s)) & U64(0x0101010101010101), begin)
        out[:, s::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), row, axis=0)
    return out


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each row."""
    size = np.diff(np.append(first, len(h)))
    ones = 2 * bit_sums(h, first) > size[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(U64).ravel()


def shingles(h: np.ndarray, doc: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row and where rows begin; a row of fewer words has one, of all its words."""
    n = np.bincount(doc, minlength=rows)
    g = grams(h, width)
    g = g[doc[: len(g)] == doc[width - 1 :]] if len(g) else g
    count = np.maximum(n - width + 1, 1)
    out = np.empty(count.sum(), U64)
    first = np.cumsum(count) - count
    full = n >= width
    out[np.repeat(full, count)] = g
    at = np.cumsum(n) - n
    for i in np.flatnonzero(~full):
        with np.errstate(over="ignore"):
            value = U64(n[i])
            for x in h[at[i] : at[i] + n[i]]:
                value = value * U64(0x9E3779B97F4A7C15) + x
        out[first[i]] = mix(np.array([value]))[0]
    return out, first


def once(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct value of each row once, ascending, and where rows begin."""
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(first)))


def sketch(h: np.ndarray, first: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """SimHash of each row, in words of 64 bits, with bits for that many blocks."""
    out = np.empty((len(first), -(-blocks * LENGTH // 64)), U64)
    for k in range(out.shape[1]):
        out[:, k] = majority(h, first)
        h = mix(h)
    return out


def block_anchors(sketched: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """Of each block of each sketch the one code word within 3, with the block's number above it."""
    out = np.empty((len(sketched), blocks), np.int32)
    for t in range(blocks):
        word, shift = divmod(t * LENGTH, 64)
        bits = sketched[:, word] >> U64(shift)
        if shift + LENGTH > 64:
            bits = bits | (sketched[:, word + 1] << U64(64 - shift))
        _, code, _ = near_words((bits & U64((1 << LENGTH) - 1)).astype(np.int64), 0)
        out[:, t] = code | (t << LENGTH)
    return out


def _shingle_sets(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a batch's texts and where rows begin."""
    w = split([x.translate(CASE) for x in texts(part.column("text"))])
    return once(*shingles(hashes(w), w.doc, part.num_rows, width))


SKETCHED = [("node", pa.int64()), ("other", pa.int64()), ("size", pa.int64()), ("v0", pa.int64()), ("v1", pa.int64()), ("anchors", pa.binary())]
MET = [("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("v0", pa.int64()), ("v1", pa.int64())]


def sketches(width: int):
    """Of each text: number of distinct shingles, the sketch's first bits and its anchors."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", 1 << 20):
            h, first = _shingle_sets(part, width)
            bits = sketch(h, first)
            at = [k.tobytes() for k in block_anchors(bits)]
            v0, v1 = (bits[:, k].view(np.int64) for k in (0, 1))
            yield record(SKETCHED, part.column("node").to_numpy(), part.column("other").to_numpy(), np.diff(np.append(first, len(h))), v0, v1, at)

    return run


def shingle_sets(width: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", 1 << 20):
            h, first = _shingle_sets(part, width)
            sets = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("other"), sets], names=["node", "other", "shingles"])

    return run


def _deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Each text to its anchors."""
    for at in range(0, batch.num_rows, 2_000):
        part = batch.slice(at, 2_000)
        anchors_ = np.frombuffer(b"".join(part.column("anchors").to_pylist()), np.int32).reshape(part.num_rows, -1)
        rest = [part.column(k).to_numpy() for k in ("node", "size", "v0", "v1")]
        for t in range(anchors_.shape[1]):
            yield record(MET, anchors_[:, t].astype(np.int64), *rest)


def _alike(size: np.ndarray, v0: np.ndarray, v1: np.ndarray, similarity: float):
    """Whether entries i and j may be that similar: by their sizes, surely, and by a sketch too far apart for all but one in 10,000."""
    most, few = loose_bits(similarity), small_bits(similarity)
    v0, v1 = v0.view(U64), v1.view(U64)  # counting bits takes signed values by their absolute

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(v0[i] ^ v0[j]) + np.bitwise_count(v1[i] ^ v1[j])
        near = apart <= max(most, few)
        at = np.flatnonzero(near)
        x, y = size[i[at]], size[j[at]]
        more = np.maximum(x, y)
        near[at] = (np.minimum(x, y) / more >= similarity) & (apart[at] <= np.where(more < SMALL, few, most))
        return near

    return test


def _begins(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.append(first, len(key)))


LED = [*MET, ("leader", pa.int64()), ("near", pa.bool_())]


def together(key: np.ndarray, node: np.ndarray, size: np.ndarray, v0: np.ndarray, v1: np.ndarray, similarity: float) -> pa.RecordBatch | None:
    """Texts at whole anchors, whose entries lie together, in groups: those that are alike, directly or through others there.

    A group's key is made of its texts, so that a group found at several anchors is one; so is its leader.
    """
    _, n = _begins(key)
    several = np.repeat(n > 1, n)
    key, node, size, v0, v1 = (c[several] for c in (key, node, size, v0, v1))
    if not len(key):
        return None
    # those like the first one of their anchor need no comparison among each other: they go to the end
    first, n = _begins(key)
    lead = np.repeat(first, n)
    member = _alike(size, v0, v1, similarity)(np.arange(len(key)), lead)
    order = np.lexsort((member, key))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    node, size, v0, v1, member, lead = (c[order] for c in (node, size, v0, v1, member, place[lead]))
    alike = _alike(size, v0, v1, similarity)
    a, b = [np.flatnonzero(member)], [lead[member]]
    rest = np.flatnonzero(~member)
    after = np.repeat(first + n, n)[rest] - rest - 1
    at, total = 0, np.cumsum(after)
    while at < len(rest):  # pairs in blocks that stay in a core's cache
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 50_000, side="right")))
        m = after[at:to]
        i = np.repeat(rest[at:to], m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        near = alike(i, j)
        u, v = forest(i[near], j[near])
        if len(u):
            a.append(u)
            b.append(v)
        at = to
    label = np.arange(len(node))
    u, v = forest(np.concatenate(a), np.concatenate(b))
    label[u] = v
    shared = np.flatnonzero(np.bincount(label, minlength=len(node))[label] > 1)
    if not len(shared):
        return None
    shared = shared[np.argsort(label[shared], kind="stable")]
    first, n = _begins(label[shared])
    with np.errstate(over="ignore"):
        name = np.repeat(np.add.reduceat(mix(node[shared].view(U64)), first), n)
    shared = shared[np.lexsort((mix(node[shared].view(U64) ^ name), label[shared]))]
    leader = np.repeat(shared[first], n)
    return record(LED, name.view(np.int64), *(c[shared] for c in (node, size, v0, v1)), node[leader], (shared != leader) & alike(shared, leader))


LED = [*MET, ("leader", pa.int64()), ("near", pa.bool_())]


def _meet(similarity: float):
    """Entries come sorted by anchor; what is held at a time is some batches, or one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, most = 0, 200_000
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows < most:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
            most = max(200_000, 2 * rows)
            if cut and (got := together(*(c[:cut] for c in cols), similarity)) is not None:
                yield got
        if rows and (got := together(*(np.concatenate(c) for c in zip(*held, strict=True)), similarity)) is not None:
            yield got

    return run


HELD = [("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("v0", pa.int64()), ("v1", pa.int64()), ("root", pa.int64()), ("side", pa.int32()), ("shingles", pa.list_(pa.int64()))]


def linked(node: np.ndarray, size: np.ndarray, v0: np.ndarray, v1: np.ndarray, root: np.ndarray, side: np.ndarray, sets: pa.ListArray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among the groups (root) of texts that meet: one text against all those of other groups, by exact similarity.

    Sets are bits of the shingles that several of these texts have. Groups that a link has joined are not compared any
    more. Texts of side 1 meet those of side 2 only; those of side 0 meet all.
    """
    values = sets.flatten().to_numpy()
    of = np.repeat(np.arange(len(node)), size)
    distinct, place, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    use = times[place] > 1
    words = max(1, -(-int((times > 1).sum()) // 64))
    bits = np.zeros((len(node), words), U64)
    at = number[place[use]]
    order = np.lexsort((at >> 6, of[use]))
    cell = (of[use] * words + (at >> 6))[order]
    if len(cell):
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        bits.ravel()[cell[new]] = np.bitwise_or.reduceat(U64(1) << (at & 63)[order].astype(U64), new)
    alike = _alike(size, v0, v1, similarity)
    _, label = np.unique(root, return_inverse=True)
    ends = label.copy()  # of each label the one it has joined
    a, b = [], []
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        own = ends[label]
        j = j[(own[j] != own[i]) & ((side[j] == 0) | (side[j] != side[i]))]
        j = j[alike(np.full(len(j), i), j)]
        for k in range(0, len(j), 2_000_000 // words + 1):
            part = j[k : k + 2_000_000 // words + 1]
            both = np.bitwise_count(bits[i] & bits[part]).sum(axis=1, dtype=np.int64)
            for other in part[both / (size[i] + size[part] - both) >= similarity].tolist():
                x, y = ends[label[i]], ends[label[other]]
                if x != y:
                    ends[ends == max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[other])
    return forest(np.array(a, np.int64), np.array(b, np.int64))


def _join_groups(similarity: float):
    """Rows of HELD come sorted by key; a key's texts are held together, as many as WEIGHT allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            cols = [table.column(n).to_numpy() for n in ("node", "size", "v0", "v1", "root", "side")]
            if len(cols[0]) > 1 and cols[4].min() < cols[4].max():
                sets = table.column("shingles").combine_chunks()
                u, v = linked(*cols, sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets, similarity)
                if len(u):
                    yield record(EDGE, u, v)

        for batch in batches:
            key = batch.column("key").to_numpy()
            first, n = _begins(key)
            for at, many in zip(first.tolist(), n.tolist(), strict=True):
                if held and held[0].column("key")[0].as_py() != key[at]:
                    yield from compare(held)
                    held = []
                held.append(batch.slice(at, many))
        if held:
            yield from compare(held)

    return run


#: Shingles of all sets that may be broadcast (16 MB); beyond, pairs and sets are shuffled.
BROADCAST = 1 << 21


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the settled pairs (a, b) whose shingle sets have that Jaccard similarity.

    A group of many texts just below it has a great many pairs of few sets: those sets aren't sent once a pair.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = sets.join(ends, "node", "left_semi")
    if (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST:
        sets = F.broadcast(sets)
    one, other = (sets.select(F.col("node").alias(a), F.col("shingles").alias(x)) for a, x in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(other, "b").filter(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b")


def bits_apart(similarity: float, bits: int = SKETCH) -> int:
    """Bits that sketches of two shingle sets of that Jaccard similarity differ in, rounded up: half the angle's share, by cosine 2J / (1 + J)."""
    from math import acos, ceil, pi

    return ceil(bits * acos(2 * similarity / (1 + similarity)) / pi)


def loose_bits(similarity: float, bits: int = SKETCH) -> int:
    """Bits that sketches at that similarity hardly ever exceed: four standard deviations over the mean."""
    from math import acos, floor, pi

    share = acos(2 * similarity / (1 + similarity)) / pi
    return floor(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)


@lru_cache
def small_bits(similarity: float, bits: int = SKETCH) -> int:
    """The same for sets of fewer than SMALL shingles, by the two such sets whose majorities differ most."""
    from math import comb, floor

    def over(have: int, own: int, size: int) -> float:
        return sum(comb(own, x) for x in range(own + 1) if 2 * (have + x) > size) / 2**own

    share = 0.0
    for a in range(1, SMALL):
        for b in range(a, SMALL):
            for c in range(1, a + 1):
                if c / (a + b - c) >= similarity:
                    p = [(over(k, a - c, a), over(k, b - c, b)) for k in range(c + 1)]
                    share = max(share, sum(comb(c, k) * (x * (1 - y) + y * (1 - x)) for k, (x, y) in enumerate(p)) / 2**c)
    return floor(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)


def _led(classes: DataFrame, similarity: float, n: int) -> DataFrame:
    """Groups of texts that are alike at an anchor: their entries, each with its group's leader.

    An anchor with more than MOST_HELD entries is split: of its parts each two meet in a task of their own.
    """
    met = "key long, node long, size long, v0 long, v1 long"
    dealt = map_rows(classes, _deal, met)
    if classes.count() > MOST_HELD:
        full = settle(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_HELD).select("key", F.ceil(2 * F.col("n") / MOST_HELD).cast("int").alias("parts")))
        if not full.isEmpty():
            own = F.pmod(F.xxhash64("node", "key"), F.coalesce("parts", F.lit(1))).cast("int")
            meet = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda p: F.xxhash64("key", F.least(p, F.col("own")), F.greatest(p, F.col("own"))))
            # at most one anchor in MOST_HELD entries is full
            dealt = dealt.join(F.broadcast(full), "key", "left").withColumn("own", own).select(F.explode(meet).alias("key"), "node", "size", "v0", "v1")
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key")
    return settle(dealt.mapInArrow(_meet(similarity), f"{met}, leader long, near boolean").dropDuplicates(["key", "node"]))


def _stars(led: DataFrame) -> DataFrame:
    return settle(led.filter("near").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())


def _open(led: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of keys whose texts are in several components, with their component (root) and the shingles of all the key's texts (weight)."""
    entries = led.join(groups, "node", "left").select("key", "node", "size", "v0", "v1", F.coalesce("root", "node").alias("root"))
    mixed = entries.groupBy("key").agg(F.sum("size").alias("weight"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "weight")
    return settle(entries.join(mixed, "key"))


def _links_across(entries: DataFrame, sets: DataFrame, similarity: float, n: int) -> DataFrame:
    """Star edges (a, b) between groups of the same key.

    A key's texts meet in one task. Those of a key with more than WEIGHT shingles are dealt over parts, and each pair of
    parts is a task of its own, so what a task holds is bounded. Only links leave a task.
    """
    parts = F.ceil(F.col("weight") / WEIGHT).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("a"), F.greatest(p, F.col("own")).alias("b")))
    dealt = entries.withColumn("parts", parts).withColumn("own", own).withColumn("m", F.explode(meet))
    side = F.when(F.col("m.a") == F.col("m.b"), 0).when(F.col("own") == F.col("m.a"), 1).otherwise(2)
    key = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", "m.a", "m.b"))
    rows = dealt.select(key.alias("key"), "node", "size", "v0", "v1", "root", side.alias("side")).join(sets, "node").select(*[c for c, _ in HELD])
    return settle(rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_join_groups(similarity), "a long, b long"))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """(node, root) of every distinct text with a near copy: node is xxhash64 of the text, null as empty.

    Near copies are texts whose sets of word shingles of `width` (A-Z lower-cased) have that Jaccard similarity. Of each
    set a SimHash of BLOCKS blocks is made; in each block every text goes to the one anchor (word of the perfect Golay
    code) that covers it. Pairs to compare share one of these anchors, which misses one pair at 0.8 in some 30,000, and
    one in 500 where sets are smallest (4 of 5 shingles); at an anchor sizes and 128 of the bits drop far ones; the
    others are compared exactly. First every text is compared with the leader of each of its groups of texts alike.
    Where that leaves texts of a group in several components, these are compared in the group's task, from which only
    links come out; groups too heavy for a task are dealt over several. A text of fewer words is one shingle. Of unequal
    texts with equal hashes, the one with the least second hash is the node, and the others have no near copies.
    """
    n = shuffle_count(docs.sparkSession)
    given = docs.select(F.coalesce(text, F.lit("")).alias("text")).select("text", text_hash("text").alias("node"), second_hash("text").alias("other"))
    rows = settle(map_rows(given, sketches(width), "node long, other long, size long, v0 long, v1 long, anchors binary"))
    classes = settle(rows.groupBy("node").agg(F.min(F.struct("other", "size", "v0", "v1", "anchors")).alias("m")).select("node", "m.*").drop("other"))
    forget(rows)
    led = _led(classes, similarity, n)
    forget(classes)
    nodes = settle(led.select("node").distinct())
    # without a shuffle of texts, so that a text of many rows doesn't come to one task
    needed = given.join(F.broadcast(nodes) if nodes.count() <= BROADCAST else nodes, "node", "left_semi")
    sets = map_rows(needed, shingle_sets(width), "node long, other long, shingles array<long>")
    sets = settle(sets.groupBy("node").agg(F.min(F.struct("other", "shingles")).alias("m")).select("node", "m.shingles"))
    stars = _stars(led)
    groups = components(similar(stars, sets, similarity))
    entries = _open(led, groups)
    edges = groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_links_across(entries, sets, similarity, n))
    found = components(edges)
    forget(led, nodes, sets, stars, entries)
    return found


def text_hash(text: str | Column) -> Column:
    return F.xxhash64(text)


def second_hash(text: str | Column) -> Column:
    """A hash that is independent of the first; both together stand for a text."""
    return F.xxhash64(F.lit("second"), text)


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, with one of each group of exact and near copies: that of the least key, then least text hash.

    Null and empty texts are copies of each other. A row with a null key stays only where its group has no other. Texts
    are told apart by 128 bits of hashes.
    """
    from pyspark.sql import Window

    roots = near_copies(docs, width, similarity, text)
    own, other, nth = (fresh(c, docs) for c in ("own", "other", "nth"))
    bare = F.coalesce(docs[f"`{text}`"], F.lit(""))
    known = docs.withColumns({own: text_hash(bare), other: second_hash(bare)})
    keys = known.select(F.col(key).alias("key"), F.col(own).alias("node"), F.col(other).alias("other")).groupBy("node", "other").agg(F.min("key").alias("key"))
    first = keys.groupBy("node").agg(F.min("other").alias("first"))
    of = keys.join(first, "node").join(roots, "node", "left")
    own_root = F.when(F.col("other") == F.col("first"), F.coalesce("root", "node")).otherwise(F.col("node"))
    apart = F.when(F.col("other") != F.col("first"), F.col("other"))  # another text with the node's hash is alone
    order = F.struct(F.col("key").isNull().alias("n"), F.col("key"), F.col("node"), F.col("other"))
    stay = of.groupBy(own_root.alias("root"), apart.alias("apart")).agg(F.min(order).alias("s")).select("s.key", "s.node", "s.other")
    stay = stay.toDF("stay key", "stay node", "stay other")
    kept = known.join(stay, (known[own] == stay["stay node"]) & (known[other] == stay["stay other"]) & known[f"`{key}`"].eqNullSafe(stay["stay key"]))
    one = Window.partitionBy(own, other, "stay key").orderBy("stay node")
    return kept.withColumn(nth, F.row_number().over(one)).filter(F.col(nth) == 1).select(*[known[f"`{c}`"] for c in docs.columns])


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Three-word SimHash fingerprints of whole texts, linked at two bits or fewer."""
    from .common import table

    got = simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
