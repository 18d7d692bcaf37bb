"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces; a text within the budget holds at least one piece
unchanged. The pieces form a binary tree: where a part of q pieces has at most q - 1 errors, so has one of its two
halves. From each exact piece hit the parts above it are verified in turn, the smallest first, with Myers'
bit-parallel distance, and the match counts when the whole item is within the budget.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, record

RATE = 0.1
#: Characters of items that one automaton may hold; more items are searched in several readings of the documents.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def myers(pattern: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of the pattern (bit masks by character, m long) to a substring of text, and its first end; (most + 1, -1) if beyond."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Item:
    """A test item's pieces and, for each, the parts above it."""

    def __init__(self, text: str, rate: float):
        self.text, self.budget = text, int(len(text) * rate)
        n = self.budget + 1
        self.cuts = [len(text) * j // n for j in range(n + 1)]
        self.above: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        self.masks: dict[tuple[int, int], dict[str, int]] = {}
        stack = [(0, n)]
        while stack:
            lo, hi = stack.pop()
            if hi - lo == 1:
                continue
            a, b = self.cuts[lo], self.cuts[hi]
            for j in range(lo, hi):
                self.above[j].insert(0, (a, b, hi - lo - 1))
            mid = (lo + hi) // 2
            stack += [(lo, mid), (mid, hi)]

    def mask(self, a: int, b: int) -> dict[str, int]:
        got = self.masks.get((a, b))
        if got is None:
            got = self.masks[a, b] = {}
            for i, c in enumerate(self.text[a:b]):
                got[c] = got.get(c, 0) | 1 << i
        return got

    def verify(self, text: str, j: int, at: int, seen: dict) -> tuple[int, int] | None:
        """(distance, end) of the item in text if piece j, found at `at`, belongs to a match within the budget.

        What a part gives depends on its diagonal only; `seen` keeps it for the other pieces that hit there.
        """
        diagonal = at - self.cuts[j]
        best, end = 0, at + self.cuts[j + 1] - self.cuts[j]
        for a, b, most in self.above[j]:
            got = seen.get((diagonal, a, b))
            if got is None:
                begin = max(0, diagonal + a - most)
                best, end = myers(self.mask(a, b), b - a, text[begin : diagonal + b + most], most)
                if len(seen) > 10_000:
                    seen.clear()
                got = seen[diagonal, a, b] = best, end + begin
            best, end = got
            if best > most:
                return None
        return best, end


def compile_items(items: list[tuple[int, str]], rate: float):
    import ahocorasick

    automaton, parts = ahocorasick.Automaton(), {}
    compiled = [(i, Item(t, rate)) for i, t in items]
    for n, (_, item) in enumerate(compiled):
        for j in range(len(item.cuts) - 1):
            parts.setdefault(item.text[item.cuts[j] : item.cuts[j + 1]], []).append((n, j))
    for p, where in parts.items():
        automaton.add_word(p, (len(p), where))
    automaton.make_automaton()
    return automaton, compiled


def matches(text: str, automaton, compiled) -> dict[int, tuple[int, int]]:
    """For each item within its budget in a normalised text: least distance and the first end it is reached at."""
    found: dict[int, tuple[int, int]] = {}
    seen: defaultdict[int, dict] = defaultdict(dict)
    for end, (size, where) in automaton.iter(text):
        for n, j in where:
            got = found.get(n)
            if got is not None and got[0] == 0:
                continue
            hit = compiled[n][1].verify(text, j, end - size + 1, seen[n])
            if hit is not None and (got is None or hit < got):
                found[n] = hit
    return found


def holds_any(text: str, automaton, compiled) -> bool:
    """Whether a normalised text holds any item within its budget."""
    seen: defaultdict[int, dict] = defaultdict(dict)
    return any(compiled[n][1].verify(text, j, end - size + 1, seen[n]) is not None for end, (size, where) in automaton.iter(text) for n, j in where)


class Sent:
    """A broadcast block of items, compiled once in each Python worker."""

    ready: dict = {}

    def __init__(self, block, rate: float):
        self.name, self.block, self.rate = uuid.uuid4().hex, block, rate

    def __call__(self):
        if self.name not in Sent.ready:
            Sent.ready.clear()
            Sent.ready[self.name] = compile_items(self.block.value, self.rate)
        return Sent.ready[self.name]


def blocks_of(benchmark: DataFrame, rate: float, item: str, item_text: str) -> Iterator[Sent]:
    """The items with their normalised texts, broadcast in blocks of about BLOCK_CHARS characters; blank ones are left out."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).filter(F.trim(F.coalesce("t", F.lit(""))) != "")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = [(r["i"], n) for r in own.collect() if (n := normal(r["t"]))]
        if rows:
            yield Sent(spark.sparkContext.broadcast(rows), rate)


FOUND = "key long, item_id long, distance int, stop long"


def _search(block: Sent):
    kinds = [("key", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("stop", pa.int64())]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        automaton, compiled = block()
        out: tuple[list, list, list, list] = ([], [], [], [])
        for doc, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            for n, (distance, end) in matches(normal(text), automaton, compiled).items():
                for to, x in zip(out, (doc, compiled[n][0], distance, end), strict=True):
                    to.append(x)
        yield record(kinds, *out)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, distance, stop) of every test item that lies in a document within int(rate * length) edits.

    Both texts are compared in lower case with white space collapsed; distance is the least over the whole text and
    stop the first place in the collapsed text where such a match ends. Null and empty items and texts match nothing.
    Repeated documents and items give repeated rows; other columns of either table are not read, whatever their names.
    Items are broadcast in blocks of bounded size, with one reading of the documents for each block.
    """
    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = [map_rows(given, _search(block), FOUND) for block in blocks_of(benchmark, rate, item, item_text)]
    whole = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)
    return whole.withColumnRenamed("key", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all their columns, without those that hold a test item within the budget.

    Each row is judged by its own text as it passes: nothing is joined, so equal hashes or names can't mislead. Null
    and empty texts stay. A further block of items sees only what the earlier ones left.
    """
    kept = docs
    for block in blocks_of(benchmark, rate, item, item_text):

        def run(batch: pa.RecordBatch, block: Sent = block) -> Iterator[pa.RecordBatch]:
            automaton, compiled = block()
            yield batch.filter(pa.array([not t or not holds_any(normal(t), automaton, compiled) for t in batch.column(text).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(lambda batches, run=run: (y for x in batches if x.num_rows for y in run(x)), docs.schema)
    return kept


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in whole documents within a tenth of their length in edits."""
    from .common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
