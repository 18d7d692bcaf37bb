"""Token ids in binary blocks with a minimal perfect hash index.

A written table has one row per block: a few thousand documents of one shard, in order.

    shard, block      place of the block; shards follow each other in key order, blocks within a shard too
    start             ids in the shard before this block
    keys              document keys as little-endian int64, in order
    ends              where each document's ids end in the payload, in ids, as int64
    payload           raw little-endian ids, `width` bytes each
    width             2 where all ids fit, else 4
    seeds             displacements of the perfect hash, uint32, one per bucket of keys
    slots             for each slot of the perfect hash: document's place in the block, uint32
    prints            for each slot: fingerprint of its key, uint32
    low, high         least and largest key, so that a reader's filter skips other blocks

In a block, a key is found in constant time: hash it, add its bucket's displacement, compare the slot's fingerprint,
read the slice that the slot names. An index table beside the files does the same for all of them, in whatever order
they were written: it has one row for each bucket of a few thousand keys, with the perfect hash of the bucket's keys and,
for each slot, the shard, block and place of its document. A key's look-up reads the index pages of its bucket, then, by
conditions on shard and block that reach the scan, the payload pages of its block.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import MASK, U64, map_rows, mix, pieces, shuffle_count, texts
from .words import BASE, BYTE, INVERSE, powers

END_ID = 2
assert sys.byteorder == "little"
BLOCK_DOCS, BLOCK_IDS = 4096, 1 << 20

# --- encoding -----------------------------------------------------------------------------------------------------

#: Texts with white space beyond ASCII, with characters on which engines differ about it, or with a special token, are
#: encoded whole.
WHOLE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]|<\\|endoftext\\|>")
SPACE, LETTER, MARK, LEAD, TAIL = 1, 2, 4, 8, 16


def _kinds() -> np.ndarray:
    kind = np.full(256, MARK, np.uint8)
    kind[[*range(9, 14), 32]] = SPACE
    kind[[*range(65, 91), *range(97, 123)]] = LETTER
    kind[128:] = 0
    kind[0xC3:0xCA] = LEAD  # of U+00C0 to U+027F, letters but for two signs
    kind[0x80:0xC0] = TAIL
    return kind


KIND = _kinds()


def chunks(buffer: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the chunks of texts that begin at `first` in a buffer of UTF-8.

    A chunk begins where white space does, and where an ASCII mark or digit follows a letter: the byte-level pattern
    joins neither with what stands before, so chunks can be encoded apart.
    """
    kind = KIND[buffer]
    space = (kind & SPACE) > 0
    letter = (kind & LETTER) > 0
    letter[1:] |= ((kind[1:] & TAIL) > 0) & ((kind[:-1] & LEAD) > 0) & ~((buffer[:-1] == 0xC3) & ((buffer[1:] == 0x97) | (buffer[1:] == 0xB7)))
    cut = np.zeros(len(buffer), bool)
    cut[first] = True
    cut[1:] |= (space[1:] & ~space[:-1]) | (((kind[1:] & MARK) > 0) & letter[:-1])
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(buffer))


class Encoder:
    """Texts to ids as bytes, with a bounded memory of chunks: a generation in use and the one before."""

    def __init__(self, tokenizer_file: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype, self.letter, self.most = f"<u{self.width}", "H" if self.width == 2 else "I", most
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.letter, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _look_up(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.known) + len(distinct) > self.most:
            self.before, self.known = self.known, {}
        found = list(map(self.known.get, distinct))
        open_ = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in open_:
            if (x := self.before.get(distinct[i])) is None:
                new.append(i)
            else:
                found[i] = self.known[distinct[i]] = x
        for i, x in zip(new, self._encode([distinct[i].decode() for i in new]), strict=True):
            found[i] = self.known[distinct[i]] = x
        return found

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; a text is taken apart with all others, by way of the batch's distinct chunks."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if WHOLE.search(s := t.decode()):
                out[i] = self._encode([s])[0]
            elif t:
                plain.append(i)
        if not plain:
            return out
        raw = b"".join([texts[i] for i in plain])
        buffer = np.frombuffer(raw, np.uint8)
        size = np.array([len(texts[i]) for i in plain], np.int64)
        first = np.cumsum(size) - size
        start, end = chunks(buffer, first)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(buffer) + 1, U64)
            np.cumsum(BYTE[buffer] * powers(BASE, len(buffer)), out=sums[1:])
            h = (sums[end] - sums[start]) * powers(INVERSE, len(buffer))[start] + (end - start).astype(U64)
        _, one, place = np.unique(h, return_index=True, return_inverse=True)
        ids = self._look_up([raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
        length = np.array([len(x) for x in ids], np.int64) // self.width
        offset = np.cumsum(length) - length
        stored = np.frombuffer(b"".join(ids), self.dtype)
        n = length[place]
        upto = np.cumsum(n)
        tokens = stored[np.arange(upto[-1]) + np.repeat(offset[place] - upto + n, n)].tobytes()
        edge = np.append(0, upto)[np.append(np.searchsorted(start, first), len(start))] * self.width
        for i, a, b in zip(plain, edge.tolist(), edge[1:].tolist(), strict=False):
            out[i] = tokens[a:b]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


# --- minimal perfect hash -----------------------------------------------------------------------------------------


def key_hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, slot hash and fingerprint of each key."""
    h = mix(keys.astype(np.int64).view(U64))
    g = mix(h)
    return h >> U64(40), g >> U64(24), (g & U64(0xFFFFFF)) << U64(8) | (h & U64(0xFF))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seeds, slots, prints for the distinct keys of a block; a repeated key stands for its first place.

    Buckets are placed from the fullest to the emptiest; a bucket's displacement is the first that puts all its keys
    on free slots.
    """
    keys, first = np.unique(keys, return_index=True)
    n = len(keys)
    if not n:
        return (np.zeros(0, "<u4"),) * 3
    b, s, p = key_hashes(keys)
    m = max(1, n // 2)
    buckets: dict[int, list[int]] = {}
    for i, k in enumerate((b % U64(m)).tolist()):
        buckets.setdefault(k, []).append(i)
    s = s.tolist()
    seeds, slots, prints = np.zeros(m, "<u4"), np.zeros(n, "<u4"), np.zeros(n, "<u4")
    taken = bytearray(n)
    free = 0
    for k in sorted(buckets, key=lambda k: (-len(buckets[k]), k)):
        own = [s[i] for i in buckets[k]]
        if len(own) == 1:
            while taken[free]:
                free += 1
            d = _displacement_to(own[0], free, n)
            at = [free]
        else:
            d = 0
            while True:
                at = [_slot(x, d, n) for x in own]
                if len(set(at)) == len(at) and not any(taken[x] for x in at):
                    break
                d += 1
        seeds[k] = d
        for i, x in zip(buckets[k], at, strict=True):
            taken[x] = 1
            slots[x], prints[x] = first[i], p[i]
    return seeds, slots, prints


def _slot(x: int, d: int, n: int) -> int:
    """Displacement d = turn * n + shift: a hash of the key and the turn, shifted."""
    turn, shift = divmod(d, n)
    if turn:
        x = ((x ^ turn * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & MASK) >> 32
    return (x + shift) % n


def _displacement_to(x: int, slot: int, n: int) -> int:
    return (slot - x) % n


def find(key: int, seeds: np.ndarray, slots: np.ndarray, prints: np.ndarray) -> int | None:
    """Place of a key in its block, or None; a foreign key passes with a chance of 2**-32."""
    if not len(slots):
        return None
    b, s, p = (int(x[0]) for x in key_hashes(np.array([key])))
    at = _slot(s, int(seeds[b % len(seeds)]), len(slots))
    return int(slots[at]) if int(prints[at]) == p else None


# --- files --------------------------------------------------------------------------------------------------------

BLOCK = "shard long, block long, start long, keys binary, keyless binary, ends binary, payload binary, width int, seeds binary, slots binary, prints binary, low long, high long"


def _blocks(tokenizer_file: str, end_id: int):
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 4 + [pa.int32()] + [pa.binary()] * 3 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        end = np.array([end_id], encode.dtype).tobytes()
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k = np.array([x or 0 for x in keys], "<i8")
            has = np.flatnonzero([x is not None for x in keys])
            low, high = (int(k[has].min()), int(k[has].max())) if len(has) else (None, None)
            seeds, slots, prints = build_index(k[has])
            index = [x.tobytes() for x in (seeds, has[slots].astype("<u4"), prints)]
            keyless = np.packbits([x is None for x in keys]).tobytes() if len(has) < len(keys) else b""
            ends = np.cumsum([len(x) for x in ids], dtype="<i8") // encode.width
            row = [shard, block, start, k.tobytes(), keyless, ends.tobytes(), b"".join(ids), encode.width, *index, low, high]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                for k, x in zip(part.column("key").to_pylist(), encode(texts(part.column("text"))), strict=True):
                    keys.append(k)
                    ids.append(x + end)
                    size += len(x) // encode.width + 1
                    if size >= BLOCK_IDS or len(keys) >= BLOCK_DOCS:
                        yield flush()
                        block, start, keys, ids, size = block + 1, start + size, [], [], 0
        if keys:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, key: str = "doc_id", text: str = "text", order: list[Column] | None = None, end_id: int = END_ID, keyless: bool = False) -> None:
    """Encode whole texts and write them as blocks in ascending order of `order` (the key unless given).

    Null text is empty: it has the end id alone. Rows with a null key can't be addressed: with `keyless` they keep their
    ids, after all others in order of key, and are read with a null doc_id but not found by the index; without it
    they raise an error. Rows of equal key all keep their ids, in order of their text; the index names the first of a
    block. An empty table gives a table without blocks. Texts are moved once, to the range of their key.
    """
    known = F.col(key).cast("long")
    if not keyless:
        known = F.coalesce(known, F.raise_error(F.lit("a document without a key can't be indexed")).cast("long"))
    given = docs.select(known.alias("key"), F.col(text).alias("text"), *[c.alias(f"order{i}") for i, c in enumerate(order or [])])
    by = [F.col(f"order{i}") for i in range(len(order or []))] or [F.col("key").asc_nulls_last()]
    dealt = given.repartitionByRange(shuffle_count(docs.sparkSession), *by).sortWithinPartitions(*by, F.col("key").asc_nulls_last(), "text").select("key", "text")
    dealt.mapInArrow(_blocks(tokenizer_file, end_id), BLOCK).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written table with `base`, the ids of all shards before."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = blocks.select("shard", (F.length("payload") / F.col("width")).cast("long").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = W.Window.orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a shard
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(bases), "shard")


def _documents(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(batch.num_rows):
        row = {k: batch.column(k)[i].as_py() for k in ("keys", "keyless", "ends", "payload", "width", "start", "base")}
        keys, ends = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ends"], "<i8")
        raw = memoryview(np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4").tobytes())
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        none = np.unpackbits(np.frombuffer(row["keyless"], np.uint8), count=len(keys)).astype(bool) if row["keyless"] else None
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=none), *(pa.array(x, pa.int64()) for x in (starts + row["start"] + row["base"], ends - starts, crc))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written table: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    return map_rows(read_blocks(spark, path).select("keys", "keyless", "ends", "payload", "width", "start", "base"), _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of a stated list of keys, through the index of the blocks whose key range holds them."""
    wanted = sorted(set(keys))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            index = [np.frombuffer(row[k], "<u4") for k in ("seeds", "slots", "prints")]
            ends, ids = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["payload"], f"<u{row['width']}")
            for k in wanted:
                if row["low"] <= k <= row["high"] and (at := find(k, *index)) is not None:
                    out[0].append(k)
                    out[1].append(ids[ends[at - 1] if at else 0 : ends[at]].astype(np.int64))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["key", "ids"])

    blocks = spark.read.schema(BLOCK).parquet(path)
    if not wanted:
        return spark.createDataFrame([], "key long, ids array<long>")
    near = blocks.filter((F.col("low") <= wanted[-1]) & (F.col("high") >= wanted[0]))
    return map_rows(near.select("ends", "payload", "width", "seeds", "slots", "prints", "low", "high"), run, "key long, ids array<long>")


INDEX = "bucket long, buckets long, seeds binary, slots binary, prints binary, shards binary, blocks binary, places binary"
KEYS_A_BUCKET = 4096


def _places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Where each key of a block is; documents without a key are left out."""
    for row in batch.to_pylist():
        keys = np.frombuffer(row["keys"], "<i8")
        has = ~np.unpackbits(np.frombuffer(row["keyless"], np.uint8), count=len(keys)).astype(bool) if row["keyless"] else np.ones(len(keys), bool)
        n = int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array(keys[has]), pa.array(np.full(n, row["shard"])), pa.array(np.full(n, row["block"])), pa.array(np.flatnonzero(has).astype(np.int64))], names=["key", "shard", "block", "place"])


def _buckets(buckets: int):
    """One index row for each bucket; rows come sorted by bucket."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64()] * 2 + [pa.binary()] * 6

    def made(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        keys, *where = (np.array(c, "<i8") for c in zip(*rows, strict=True))
        values = [bucket, buckets, *(x.tobytes() for x in build_index(keys)), *(x.tobytes() for x in where)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if rows:
                        yield made(now, rows)
                    now, rows = bucket, []
                rows.append(tuple(row))
        if rows:
            yield made(now, rows)

    return run


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """The index table of written files. A repeated key stands for its first place; documents without a key are not in it."""
    blocks = spark.read.schema(BLOCK).parquet(path).select("shard", "block", "keys", "keyless")
    n = blocks.agg(F.sum(F.length("keys"))).first()[0] or 0
    buckets = max(1, n // (8 * KEYS_A_BUCKET))
    places = map_rows(blocks, _places, "key long, shard long, block long, place long")
    one = places.groupBy("key").agg(F.min(F.struct("shard", "block", "place")).alias("at"))
    dealt = one.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "at.*").repartition(shuffle_count(spark), "bucket").sortWithinPartitions("bucket", "key")
    dealt.mapInArrow(_buckets(buckets), INDEX).write.option("compression", "zstd").parquet(index)


def seek(spark: SparkSession, path: str, index: str, keys: list[int]) -> DataFrame:
    """(key, ids) of a stated list of keys: one index row and one block for each. Keys that aren't there give no row."""
    wanted = np.unique(np.array(keys, np.int64))
    table = spark.read.schema(INDEX).parquet(index)
    head = table.select("buckets").first()
    if head is None or not len(wanted):
        return spark.createDataFrame([], "key long, ids array<long>")
    of = mix(wanted.view(U64)).view(np.int64) % head["buckets"]
    by_bucket: dict[int, list[int]] = {}
    for k, b in zip(wanted.tolist(), of.tolist(), strict=True):
        by_bucket.setdefault(b, []).append(k)

    def locate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row in batch.to_pylist():
            hashed = [np.frombuffer(row[c], "<u4") for c in ("seeds", "slots", "prints")]
            where = [np.frombuffer(row[c], "<i8") for c in ("shards", "blocks", "places")]
            out += [(k, *(int(w[at]) for w in where)) for k in by_bucket.get(row["bucket"], ()) if (at := find(k, *hashed)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["key", "shard", "block", "place"])

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for row in batch.to_pylist():
            ends = np.frombuffer(row["ends"], "<i8")
            at = row["place"]
            if np.frombuffer(row["keys"], "<i8")[at] == row["key"]:  # a foreign key may share its fingerprint
                keys.append(row["key"])
                ids.append(np.frombuffer(row["payload"], f"<u{row['width']}")[ends[at - 1] if at else 0 : ends[at]].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["key", "ids"])

    found = map_rows(table.filter(F.col("bucket").isin(sorted(by_bucket))), locate, "key long, shard long, block long, place long")
    rows = found.collect()  # a row for each stated key that is there
    if not rows:
        return spark.createDataFrame([], "key long, ids array<long>")
    # both conditions reach the scan: of the payload only pages of these shards and blocks are read
    near = F.col("shard").isin(sorted({r["shard"] for r in rows})) & F.col("block").isin(sorted({r["block"] for r in rows}))
    blocks = spark.read.schema(BLOCK).parquet(path).filter(near).select("shard", "block", "keys", "ends", "payload", "width")
    return map_rows(blocks.join(F.broadcast(spark.createDataFrame(rows, found.schema)), ["shard", "block"]), read, "key long, ids array<long>")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole documents, written in order of doc_id and read back."""
    from .common import shared_path, table

    path = shared_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(), keyless=True)
    return read_ids(spark, path)

