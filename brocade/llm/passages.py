"""Removal of repeated passages with sharded Aho-Corasick automata.

1. Each window of words is represented by its minimizer, the least-hashed short gram in it; equal windows
   have equal minimizers. Minimizers seen in two documents at least are counted and set in a bitmap.
2. Every document is read again, once; each stretch of windows whose minimizer is in the bitmap (a fragment) is noted by
   its place, its key and its hash. The key is the minimizer, or for very frequent ones a hash of each window, so that a
   common phrase in ever new surroundings spreads over shards. A fragment's words go to its key's shard, once per batch
   of documents. The bitmap only drops most of what doesn't recur: where it is too small for that, a join with the
   recurring minimizers drops the rest.
3. In each shard the windows of its distinct fragments are counted word for word; passages of windows that start in
   two documents at least are compiled into an automaton, and all its distinct fragments are streamed through it.
4. What is found in a fragment holds for all its places: they are joined with it and go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, map_rows, mix, pieces, record, settle, shuffle_count, texts
from .words import BASE, INVERSE, Words, gather, grams, hashes, powers, split

#: Bytes of text taken at a time in the first and in the second reading, where each piece sends a fragment's words once.
PIECE, WIDE = 1 << 20, 3 << 20


def minimizers(w: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows of one row that share a minimizer: its hash, first and last window (by first word)."""
    n = len(h) - window + 1
    if n <= 0:
        return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(h, gram)
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(n)
    i = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    if not len(i):
        return h[:0], i, i
    at = at[i]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)]))
    return g[at[first]], i[first], i[np.append(first[1:], len(i)) - 1]


def _seeds(window: int, gram: int):
    kinds = [("seed", pa.int64()), ("doc", pa.int64())]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", PIECE):
            w = split(texts(part.column("text")))
            seed, first, _ = minimizers(w, hashes(w), window, gram)
            yield record(kinds, seed.view(np.int64), part.column("doc").to_numpy()[w.doc[first]] if len(first) else first)

    return run


NOTES = "seed long, key long, hash long, doc long, same long, at int, low long, high long, fragment binary"


def _is_set(bitmap: np.ndarray, seed: np.ndarray) -> np.ndarray:
    bit = (seed % U64(8 * len(bitmap))).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7)) & 1 > 0


def spread(h: np.ndarray, seed: np.ndarray, first: np.ndarray, last: np.ndarray, common: np.ndarray, window: int):
    """Fragments (seed, key, first and last window): those of a common seed are taken apart into single windows, whose hash is the key."""
    n = np.where(common, last - first + 1, 1)
    of = np.repeat(np.arange(len(seed)), n)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    seed, common, at = seed[of], common[of], first[of] + shift
    own = grams(h, window)[at]
    return seed, np.where(common, mix(seed ^ own), seed), at, np.where(common, at, last[of])


def _fragments(window: int, gram: int, recurring, common):
    kinds = [(n, pa.binary() if n == "fragment" else pa.int32() if n == "at" else pa.int64()) for n in (x.split()[0] for x in NOTES.split(", "))]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, often = (np.frombuffer(b.value, np.uint8) for b in (recurring, common))
        for part in pieces(batch, "text", WIDE):
            w = split(texts(part.column("text")))
            h = hashes(w)
            seed, first, last = minimizers(w, h, window, gram)
            hit = _is_set(known, seed)
            seed, first, last = seed[hit], first[hit], last[hit]
            if not len(seed):
                continue
            seed, key, first, last = spread(h, seed, first, last, _is_set(often, seed), window)
            stop = last + window
            with np.errstate(over="ignore"):  # the words' hash by prefix sums
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * powers(BASE, len(h)), dtype=U64)])
                own = mix((sums[stop] - sums[first]) * powers(INVERSE, len(h) + 1)[first] + (stop - first).astype(U64)).view(np.int64)
            row = w.doc[first]
            doc = part.column("doc").to_numpy()[row]
            order = np.lexsort((own, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])
            group, start = np.cumsum(new) - 1, np.flatnonzero(new)
            low, high = np.minimum.reduceat(doc[order], start)[group], np.maximum.reduceat(doc[order], start)[group]
            size = np.where(new, (w.end[stop - 1] - w.start[first])[order], 0)
            data, offsets = gather(w.buffer, w.start[first][order], w.start[first][order] + size)
            nulls = pa.py_buffer(np.packbits(new, bitorder="little").tobytes())
            fragment = pa.Array.from_buffers(pa.binary(), len(order), [nulls, pa.py_buffer(offsets), pa.py_buffer(data)])
            low, high = (pa.array(x, pa.int64(), mask=~new) for x in (low, high))  # they stand with the fragment's words
            yield record(kinds, seed.view(np.int64)[order], key.view(np.int64)[order], own[order], doc[order], part.column("same").to_numpy()[row][order], (first - w.first[row]).astype(np.int32)[order], low, high, fragment)

    return run


class Shard:
    """The automaton of one shard's fragments.

    A phrase is `window` words that start in two documents at least. Consecutive phrases that never occur apart, with
    the same least document, are one passage. Words are spelled with letters of alphabets that differ by place, so a
    match begins and ends with whole words.
    """

    def __init__(self, window: int, fragments: dict[bytes, tuple[int, int]]):
        import ahocorasick

        self.window = window
        rows = [x.split(b" ") for x in fragments]
        ids: dict[bytes, int] = {}
        for row in rows:
            for x in row:
                ids.setdefault(x, len(ids))
        self.letters = 2 if len(ids) <= 1 << 16 else 4
        spell = {x: "".join(chr(0x100 + (p << 8) + (i >> (8 * p) & 255)) for p in range(self.letters)) for x, i in ids.items()}
        k = self.letters
        size = k * window
        self.spelled = [("".join([spell[x] for x in row]), len(row)) for row in rows]
        seen: dict[str, list[int]] = {}
        pairs: dict[str, int] = {}
        for f, ((text, n), (low, high)) in enumerate(zip(self.spelled, fragments.values(), strict=True)):
            for i in range(0, k * (n - window + 1), k):
                phrase = text[i : i + size]
                got = seen.get(phrase)
                if got is None:
                    seen[phrase] = [low, high, 1, f]
                else:
                    if low < got[0]:
                        got[0] = low
                    if high > got[1]:
                        got[1] = high
                    got[2] += 1
                if i:
                    pair = text[i - k : i + size]
                    pairs[pair] = pairs.get(pair, 0) + 1
        self.automaton = ahocorasick.Automaton()
        for f, (text, n) in enumerate(self.spelled):
            i, stop = 0, k * (n - window + 1)
            while i < stop:
                low, high, times, own = seen[text[i : i + size]]
                if own != f or low >= high:
                    i += k
                    continue
                j = i + k
                while j < stop:
                    nxt = seen[text[j : j + size]]
                    if nxt[3] != f or nxt[0] != low or nxt[2] != times or pairs[text[j - k : j + size]] != times:
                        break
                    j += k
                self.automaton.add_word(text[i : j - k + size], (low, (j - i) // k))
                i = j
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def occurrences(self, f: int) -> list[tuple[int, int, int]]:
        """(first word, number of phrases, least document) of each passage in the f-th fragment."""
        if not self.any:
            return []
        k = self.letters
        return [((end + 1) // k - (self.window + n - 1), n, low) for end, (low, n) in self.automaton.iter(self.spelled[f][0])]


FOUND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("low", pa.int64())]))


def _stream(window: int):
    """Rows come sorted by shard; a shard's fragments are held together, those of equal words as one."""
    names = ["key", "hash", "found"]

    def search(seeds: dict, fragments: dict) -> pa.RecordBatch | None:
        shard, out = Shard(window, fragments), ([], [], [])
        for f, (seed, own) in enumerate(seeds.values()):
            if got := shard.occurrences(f):
                for to, x in zip(out, (seed, own, [(i, i + n - 1 + window, low) for i, n, low in got]), strict=True):
                    to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], FOUND)], names=names) if out[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seeds, fragments = None, {}, {}
        for batch in batches:
            for of, seed, own, low, high, text in zip(*(batch.column(k).to_pylist() for k in ("shard", "key", "hash", "low", "high", "fragment")), strict=True):
                if of != now:
                    if fragments and (got := search(seeds, fragments)) is not None:
                        yield got
                    now, seeds, fragments = of, {}, {}
                had = fragments.get(text)
                if had is None:
                    seeds[text], fragments[text] = (seed, own), (low, high)
                elif low < had[0] or high > had[1]:
                    fragments[text] = (min(low, had[0]), max(high, had[1]))
        if fragments and (got := search(seeds, fragments)) is not None:
            yield got

    return run


def bitmap_of(seeds: DataFrame, bits: int) -> bytes:
    """A bit for each seed; built by tasks in chunks of 4 KB, of which the driver puts together bits / 8 bytes whatever the seeds' number."""
    bit = seeds.select(F.col("seed").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    chunks = bit.groupBy(F.floor(F.col("bit") / 32768).alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("set"))
    whole = np.zeros((bits // 32768, 4096), np.uint8)
    for chunk in chunks.toLocalIterator():
        whole[chunk["chunk"]] = np.frombuffer(chunk["set"], np.uint8)
    return whole.tobytes()


def repeated_ranges(docs: DataFrame, window: int = 13, gram: int = 5, bits: int = 1 << 27, a_shard: int = 32_768) -> DataFrame:
    """(doc, same, spans): word ranges (start, stop) made of windows that also start in a document of a smaller id.

    docs: long doc, long same (hash of the text, parts rows of equal id), string text. Ranges may overlap. Documents are
    read twice whatever the size of the corpus. The bitmap of recurring minimizers has 8 bits for each, and `bits` (16
    MB) at most; where that is not enough, most fragments pass it and those that don't recur are dropped by a join with
    the recurring minimizers, split by Spark where one is hot. A shard has about `a_shard` occurrences of fragments, and
    minimizers that alone have more are spread by window.
    """
    spark = docs.sparkSession
    n = shuffle_count(spark)
    docs = docs.filter("doc is not null and text is not null")
    seeds = map_rows(docs.select("doc", "text"), _seeds(window, gram), "seed long, doc long")
    recurring = settle(seeds.groupBy("seed").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("times")).filter("low < high").select("seed", "times"))
    whole = recurring.agg(F.count(F.lit(1)).alias("seeds"), F.coalesce(F.sum("times"), F.lit(0)).alias("times")).first()
    shards = max(8 * n, -(-whole["times"] // a_shard))
    size = min(bits, 1 << max(20, (8 * whole["seeds"]).bit_length()))
    common = recurring.filter(F.col("times") > max(512, whole["times"] // shards))
    sent = [spark.sparkContext.broadcast(bitmap_of(x, size)) for x in (recurring, common)]
    notes = map_rows(docs.select("doc", "same", "text"), _fragments(window, gram, *sent), NOTES)
    if size < 4 * whole["seeds"]:
        notes = notes.join(recurring.select("seed"), "seed", "left_semi")
    notes = settle(notes.drop("seed"))
    shard = F.pmod(F.shiftrightunsigned("key", 8), F.lit(shards)).alias("shard")
    patterns = notes.filter("fragment is not null").select(shard, "key", "hash", "low", "high", "fragment").repartition(max(n, whole["times"] // 500_000), "shard").sortWithinPartitions("shard")
    passages = settle(patterns.mapInArrow(_stream(window), "key long, hash long, found array<struct<start:int,stop:int,low:long>>"))
    forget(recurring)
    places = notes.select("key", "hash", "doc", "same", "at").join(passages, ["key", "hash"])
    spans = F.transform(F.filter("found", lambda x: x["low"] < F.col("doc")), lambda x: F.struct((x["start"] + F.col("at")).alias("start"), (x["stop"] + F.col("at")).alias("stop")))
    ranges = settle(places.select("doc", "same", spans.alias("spans")).filter("size(spans) > 0"))
    forget(notes, passages)
    # rows of equal id and text have equal spans: as a set they count once
    return ranges.groupBy("doc", "same").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _kept(key: str):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            w = text.split()
            n_words.append(len(w))
            gone = np.zeros(len(w) + 1, np.int64)
            for s in spans or ():
                gone[s["start"]] += 1
                gone[s["stop"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g] if spans else w))
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_removed and kept, its words that no repeated window covers, space-joined.

    A window of `window` words is repeated if its words also start in a document with a smaller key, wherever there.
    Null text has no words. Rows with a null key are returned whole and repeat nothing. Rows of equal key are one
    document to each other: they don't repeat each other. Ties and extra columns don't matter.
    """
    given = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).withColumn("same", F.xxhash64("text"))
    joined = given.join(repeated_ranges(given, window), ["doc", "same"], "left").select(F.col("doc").alias(key), "text", "spans")
    return map_rows(joined, _kept(key), f"`{key}` long, n_words long, n_removed long, kept string")


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    """Words of whole documents left after removing 13-word windows repeated from smaller ids."""
    from .common import table

    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
  windows AS (SELECT r, doc_id, i, list_slice(t, i, i + 12) AS w FROM given, LATERAL (SELECT unnest(range(1, len(t) - 11)) AS i)),
  first AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
  covered AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows JOIN first USING (w) WHERE least < doc_id),
  removed AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
  words AS (SELECT r, p, t[p] AS word FROM given, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS p)),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(t) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM given LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)"""


def brute_force(docs: list[tuple[int, str]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    """The same by its definition, for tests."""
    import re

    first: dict[tuple, int] = {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            p = tuple(w[k : k + window])
            first[p] = min(first.get(p, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
