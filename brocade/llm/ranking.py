"""Ranked lexical search by pipelined term partitioning.

The terms of a block of items are shared out over owners by how many documents hold them, the rarest first. An item
bundle carries its documents' accumulators, as sparse (item, document) scores, through one stage an owner: a cogroup
with that owner's postings adds integer contributions. Between stages an accumulator goes on only if, with all that the
owners ahead can add, it can still reach the item's k-th highest score so far; that loses nothing, since contributions
aren't negative. The last stage selects the highest.

Documents are dealt in blocks of a bounded number, and bundles meet postings block by block, so no task holds more than
one block of one bundle, however frequent a term or crowded a source is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, pieces, settle, texts

#: Owners of terms, as the greatest share of documents that hold the terms of each but the last.
OWNERS = (1 / 128, 1 / 16, 1 / 4)
#: Items of a bundle, documents of a block, bytes of text tokenised at a time, bytes of items that share one reading of the documents.
BUNDLE, BLOCK_DOCS, PIECE, ITEM_BYTES = 256, 4096, 8 << 20, 4 << 20

_code = np.arange(256)
#: A byte of a term in lower case; 0 for bytes that part terms.
FOLDED = np.where((_code >= 65) & (_code <= 90), _code + 32, np.where((_code >= 48) & (_code <= 57) | (_code >= 97) & (_code <= 122) | (_code >= 128), _code, 0)).astype(np.uint8)
PARTING = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(rows: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms in reading order, in lower case, and the row of each."""
    folded = FOLDED[np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)]
    inside = folded > 0
    edge = np.diff(np.concatenate([[False], inside]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])])
    return found, np.searchsorted(np.cumsum([len(x) + 1 for x in rows]), start, side="right")


def parts(rows: list[bytes], most: int = PIECE) -> Iterator[tuple[list[int], list[bytes]]]:
    """The rows in groups of about `most` bytes; a longer row comes in parts, cut where a term ends."""
    number, held, size = [], [], 0
    for i, x in enumerate(rows):
        at = 0
        while True:
            cut = len(x)
            if cut - at > most:
                gap = PARTING.search(x, at + most)
                cut = gap.start() if gap else cut
            number.append(i)
            held.append(x[at:cut])
            size += cut - at
            if size >= most:
                yield number, held
                number, held, size = [], [], 0
            at = cut
            if at >= len(x):
                break
    if held:
        yield number, held


def counted(rows: list[bytes], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n: terms of each row, with repeats. term, row, tf: how often each term of the vocabulary occurs in each row that holds it, by term and row."""
    n = np.zeros(len(rows), np.int64)
    keys, counts = [], []
    for number, held in parts(rows):
        found, of = terms_of(held)
        row = np.array(number)[of]
        n += np.bincount(row, minlength=len(rows))
        term = pc.index_in(found, vocabulary)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        key, count = np.unique(term.drop_null().to_numpy().astype(np.int64) * len(rows) + row[known], return_counts=True)
        keys.append(key)
        counts.append(count)
    if not keys:
        return n, *(np.zeros(0, np.int64),) * 3
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
    return n, key // max(len(rows), 1), key % max(len(rows), 1), tf


BLOCKS = "block long, docs int, ids array<long>, n binary, filled long, tokens long, terms array<int>, df array<int>, places binary, tf binary"


def _blocks(sent, size: int):
    """Rows (id, text) to blocks of documents with the postings of the vocabulary; places and tf are in order of term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, made, task = pa.array(sent.value, pa.binary()), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in pieces(batch, "text", 4 * PIECE):
                for at in range(0, piece.num_rows, size):
                    part = piece.slice(at, size)
                    n, term, row, tf = counted(texts(part.column("text")), vocabulary)
                    held, df = np.unique(term, return_counts=True)
                    values = [(task << 33) + made, part.num_rows, part.column("id").to_pylist(), n.astype("<i4").tobytes(), int((n > 0).sum()), int(n.sum()), held.astype(np.int32), df.astype(np.int32), row.astype("<u2").tobytes(), tf.astype("<i4").tobytes()]
                    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return run


class Plan:
    """What every stage knows of a block of items: weights and owners of terms, and which items of which bundle hold a term."""

    def __init__(self, items: list[list[int]], df: np.ndarray, documents: int, tokens: int, owners: tuple[float, ...]):
        self.documents, self.tokens, self.stages = documents, tokens, len(owners) + 1
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
        self.owner = np.searchsorted(np.array(owners) * documents, df, side="left")
        self.bundles: list[dict[int, np.ndarray]] = []
        self.sizes: list[int] = []
        # what owners from a stage on can add to an item at most: a term gives less than a million times its weight
        self.ahead = np.zeros((self.stages + 1, len(items)), np.int64)
        for at in range(0, len(items), BUNDLE):
            users: dict[int, list[int]] = {}
            for i, own in enumerate(items[at : at + BUNDLE]):
                for t in own:
                    users.setdefault(t, []).append(i)
                    self.ahead[: self.owner[t] + 1, at + i] += self.weight[t] * 1_000_000
            self.bundles.append({t: np.array(u) for t, u in users.items()})
            self.sizes.append(len(items[at : at + BUNDLE]))

    def share(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """(1000000000 * tf) div (1000 * tf + 8 * m) of documents of n terms."""
        wide = np.int64 if 90 * int(n.max(initial=0)) * self.documents < 1 << 62 else object
        m = 100 - 90 + (90 * n.astype(wide) * self.documents) // self.tokens
        return ((1_000_000_000 * tf.astype(wide)) // (1000 * tf.astype(wide) + 8 * m)).astype(np.int64)


POSTINGS = "bundle int, block long, n binary, ids array<long>, terms array<int>, df array<int>, places binary, tf binary"


def _owned(sent, stage: int):
    """A block's postings of the terms that the stage's owner holds, one row for each bundle that asks for any; the last stage has all blocks, for their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        last = stage == plan.stages - 1
        asked = [np.isin(np.arange(len(plan.owner)), list(b)) & (plan.owner == stage) for b in plan.bundles]
        names = [c.split()[0] for c in POSTINGS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for batch in batches:
            for block in batch.to_pylist():
                terms, df = np.array(block["terms"], int), np.array(block["df"], int)
                places, tf = np.frombuffer(block["places"], "<u2"), np.frombuffer(block["tf"], "<i4")
                for b, wanted in enumerate(asked):
                    use = wanted[terms]
                    if not (last or use.any()):
                        continue
                    each = np.repeat(use, df)
                    values = [b, block["block"], block["n"], block["ids"] if last else None, terms[use].astype(np.int32), df[use].astype(np.int32), places[each].tobytes(), tf[each].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    return run


CARRIED = "bundle int, block long, docs int, keys binary, scores binary, item array<int>, best array<long>"
SELECTED = "item int, doc_id long, score long"


def _visit(sent, least, stage: int, k: int):
    """One bundle's accumulators over one block of documents at an owner: scores added, and those that can't reach the item's k-th highest left behind."""

    def run(key: tuple, carried: pa.Table, postings: pa.Table) -> pa.Table:
        plan = sent.value
        bundle, block = key[0].as_py(), key[1].as_py()
        of = plan.bundles[bundle]
        floor = least.value[bundle * BUNDLE :][: plan.sizes[bundle]]
        docs = carried.column("docs")[0].as_py()
        scores = np.zeros((plan.sizes[bundle], docs), np.int64)
        scores.flat[np.frombuffer(carried.column("keys")[0].as_py(), "<u4")] = np.frombuffer(carried.column("scores")[0].as_py(), "<i8")
        row = postings.to_pylist()[0] if postings.num_rows else None
        if row:
            n, places, tf = np.frombuffer(row["n"], "<i4").astype(np.int64), np.frombuffer(row["places"], "<u2").astype(int), np.frombuffer(row["tf"], "<i4").astype(np.int64)
            share = plan.share(n[places], tf)
            at = 0
            for term, df in zip(row["terms"], row["df"], strict=True):
                scores[np.ix_(of[term], places[at : at + df])] += plan.weight[term] * share[at : at + df]
                at += df
        ahead = plan.ahead[stage + 1, bundle * BUNDLE :][: len(scores)]
        kept = (scores > 0) & (scores + ahead[:, None] >= floor[:, None])
        if stage == plan.stages - 1:
            ids = np.array([(d is None, d or 0) for d in row["ids"]], [("gone", bool), ("id", np.int64)])
            found: list[tuple[int, int | None, int]] = []
            for i in np.flatnonzero(kept.any(axis=1)):
                j = np.flatnonzero(kept[i])
                if len(j) > k:
                    j = j[scores[i, j] >= np.partition(scores[i, j], -k)[-k]]
                j = j[np.lexsort((ids["id"][j], ids["gone"][j], -scores[i, j]))[:k]]
                found += [(bundle * BUNDLE + int(i), row["ids"][x], int(scores[i, x])) for x in j]
            item, doc, score = zip(*found, strict=True) if found else ((), (), ())
            return pa.table({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})
        scores[~kept] = 0
        top = np.partition(scores, max(0, docs - k), axis=1)[:, -k:]
        i, j = np.nonzero((top > 0) & (top >= floor[:, None]))
        keys = np.flatnonzero(kept)
        values = [bundle, block, docs, keys.astype("<u4").tobytes(), scores.flat[keys].astype("<i8").tobytes(), (bundle * BUNDLE + i).astype(np.int32), top[i, j]]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.table({c.split()[0]: pa.array([v], t) for c, v, t in zip(CARRIED.split(", "), values, kinds, strict=True)})

    return run


def _floors(carried: DataFrame, items: int, k: int) -> np.ndarray:
    """The k-th highest score so far of each item that has k, else 0: one number an item of the block."""
    each = carried.select(F.explode(F.arrays_zip("item", "best")).alias("x")).select("x.item", F.col("x.best").alias("score"))
    ranked = each.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("nth") <= k)
    out = np.zeros(items, np.int64)
    for r in ranked.filter(F.col("nth") == k).collect():
        out[r["item"]] = r["score"]
    return out


def _search(docs: DataFrame, wanted: list[list[bytes]], k: int, owners: tuple[float, ...], block_docs: int) -> DataFrame | None:
    """(item, doc_id, score): candidates of each of the wanted lists of terms, its k highest among them."""
    spark = docs.sparkSession
    vocabulary = sorted({t for w in wanted for t in w})
    number = {t: i for i, t in enumerate(vocabulary)}
    words = spark.sparkContext.broadcast(vocabulary)
    blocks = settle(docs.mapInArrow(_blocks(words, block_docs), BLOCKS))
    total = blocks.agg(F.sum("filled").alias("documents"), F.sum("tokens").alias("tokens")).first()
    if not total["tokens"]:
        forget(blocks)
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect():
        df[r["terms"]] = r["df"]
    plan = Plan([[number[t] for t in w] for w in wanted], df, total["documents"], total["tokens"], owners)
    sent = spark.sparkContext.broadcast(plan)
    floors = np.zeros(len(wanted), np.int64)
    empty = [F.lit(b"").alias("keys"), F.lit(b"").alias("scores"), F.array().cast("array<int>").alias("item"), F.array().cast("array<long>").alias("best")]
    carried = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(len(plan.bundles) - 1))).alias("bundle"), "block", "docs", *empty)
    key = ["bundle", "block"]
    for stage in range(plan.stages):
        last = stage == plan.stages - 1
        postings = blocks.mapInArrow(_owned(sent, stage), POSTINGS)
        met = carried.groupBy(*key).cogroup(postings.groupBy(*key))
        after = settle(met.applyInArrow(_visit(sent, spark.sparkContext.broadcast(floors), stage, k), SELECTED if last else CARRIED))
        if stage:
            forget(carried)
        carried = after
        if not last:
            floors = _floors(carried, len(wanted), k)
    forget(blocks)
    return carried


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", owners: tuple[float, ...] = OWNERS, block_docs: int = BLOCK_DOCS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, key, score): the k documents of highest score of each item, all if fewer have a score above 0.

    Terms, weights and scores are those of the task's contract. A row is a document, so rows of equal key are ranked
    each by itself; of equal scores the least key comes first, a null key last. Null, empty and blank texts have no
    terms: such documents aren't counted and such items have no rows. Items with equal key and text count once; of equal
    key and different text, each has ranks of its own. Other columns are not read. Items go in blocks of bounded size,
    with one reading of the documents for each.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    found = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = own.collect()
        terms = [sorted(set(terms_of([(r["text"] or "").encode()])[0].to_pylist())) for r in rows]
        held = [(r["item_id"], t) for r, t in zip(rows, terms, strict=True) if t]
        best = _search(given, [t for _, t in held], k, owners, block_docs) if held else None
        if best is not None:
            nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], f"item int, item_id {kind}")
            chosen = best.withColumn("rank", nth.cast("int")).filter(F.col("rank") <= k)
            found.append(chosen.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    whole = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return whole.toDF(item, "rank", key, "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
  lengths AS (SELECT r, doc_id, len(t) AS n FROM words WHERE len(t) > 0),
  total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM lengths),
  wanted AS (SELECT DISTINCT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)),
  tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
  weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
  scored AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // tokens)))) AS BIGINT) AS score
    FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (r), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10"""


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score of every benchmark item."""
    from .common import table

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
