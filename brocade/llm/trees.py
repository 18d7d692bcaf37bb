"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner products become least distances when each vector gets one more coordinate, the root of what its square
norm lacks to the greatest one, and queries get 0 there. Every tree halves the space level by level at the median of a
random direction; a level's direction is the same for all its nodes, so a tree is its directions and one threshold a
node. A query goes down all trees from one priority queue, which holds the branches passed by, in order of how far the
query lies from them; the leaves it gives are compared with the query in full, and the exact products rank.

How many candidates the queue has to give is measured: a sample of the queries is compared with every row, and the
budget is set so that the wanted share of their true neighbours lies in the leaves that come first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, forget, settle, shuffle_count
from .embeddings import dealt
from .vectors import finite_rows, usual_length

#: Trees; vectors they are fitted to, at most; vectors of a leaf, about; levels, at most; levels of a subtree that one task takes.
TREES, SAMPLE, LEAF, MOST_LEVELS, SUBTREE = 4, 20_000, 256, 16, 6
#: Queries compared with all rows to set the budget; share of their neighbours that the budget's leaves hold; samples below which a node takes its parent's.
TRIED, WANTED, FEW = 200, 0.96, 16
#: Queries compared at a time, pairs whose exact products are held at a time, pairs of a subtree that one task compares, about.
BLOCK, PAIRS, TASK_PAIRS = 256, 200_000, 64_000_000


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors, whatever their scale."""
    top = np.abs(x).max(axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return top[:, 0] * np.sqrt(((x / np.where(top > 0, top, 1.0)) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; the same doubles for the same vectors, wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((a * b).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


class Forest:
    """Trees over vectors with one more coordinate; nodes of a level are numbered from the left."""

    def __init__(self, sample: np.ndarray, greatest: float, levels: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.greatest, self.levels = greatest, levels
        x = self.lifted(sample)
        ways = rng.standard_normal((trees, levels, x.shape[1]))
        self.ways = ways / np.sqrt((ways**2).sum(axis=2, keepdims=True)) if levels else ways
        self.cuts = [self._cuts(x @ way.T) for way in self.ways]
        self.sizes = np.zeros((trees, 1 << levels), np.int64)

    def _cuts(self, at: np.ndarray) -> list[np.ndarray]:
        """Thresholds of each level's nodes: medians of the sample there, or of the nearest node above that has some."""
        held, out = [np.arange(len(at))], []
        for level in range(self.levels):
            cut = np.array([np.median(at[h, level]) for h in held])
            out.append(cut)
            below = []
            for h, c in zip(held, cut, strict=True):
                right = at[h, level] >= c
                below += [part if len(part) >= FEW else h for part in (h[~right], h[right])]
            held = below
        return out

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        length = norms(x)
        scale = length if query else np.full(len(x), self.greatest)
        y = x / np.where(scale > 0, scale, 1.0)[:, None]
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, 1 - (length / self.greatest) ** 2))
        return np.nan_to_num(np.column_stack([y, more]))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        y = self.lifted(x)
        out = np.zeros((len(self.ways), len(x)), np.int64)
        for t, way in enumerate(self.ways):
            at = y @ way.T
            for level in range(self.levels):
                out[t] = out[t] * 2 + (at[:, level] >= self.cuts[t][level][out[t]])
        return out

    def visits(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of a query's queue over all trees: branches by the sum of their squared distances to the query."""
        at = np.einsum("tld,d->tl", self.ways, query).tolist()
        queue = [(0.0, t, 0, 0) for t in range(len(self.ways))]
        while queue:
            far, t, level, node = heapq.heappop(queue)
            while level < self.levels:
                margin = at[t][level] - self.cuts[t][level][node]
                right = margin >= 0
                heapq.heappush(queue, (far + margin * margin, t, level + 1, 2 * node + (not right)))
                node = 2 * node + right
                level += 1
            yield t, node

    def chosen(self, query: np.ndarray, budget: float, k: int) -> list[tuple[int, int]]:
        """The leaves that a query is compared with: until they hold the budget and more than k vectors of one tree, or a whole tree."""
        out, held, own, whole = [], 0, [0] * len(self.ways), int(self.sizes[0].sum())
        for t, leaf in self.visits(query):
            n = int(self.sizes[t, leaf])
            if n:
                out.append((t, leaf))
                held += n
                own[t] += n
                if held >= budget and max(own) > k or own[t] == whole:
                    break
        return out


def _valid(given: DataFrame, kind: str) -> DataFrame:
    """(id, vec, norm, d) of the rows that take part; vec holds the components as little-endian bytes of `kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in finite_rows(batch.column("e")):
                use = x.any(axis=1)
                rows, x = rows[use], x[use] + 0.0
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array(norms(x)), pa.array(np.full(len(x), x.shape[1], np.int32))], names=["id", "vec", "norm", "d"])

    return given.mapInArrow(run, "id long, vec binary, norm double, d int")


def matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)


class Best:
    """The k best classes of each query of a block: flat rows by query, falling score and least id."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k = x, k
        self.length = norms(x)
        self.query, self.place, self.score, self.least = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)
        self.floor = np.full(len(x), -np.inf)

    def add(self, queries: np.ndarray, y: np.ndarray, length: np.ndarray, place: np.ndarray, least: np.ndarray) -> None:
        """Compare the stated queries with rows y; place says where a row stands, least its tie-breaker."""
        with np.errstate(over="ignore", invalid="ignore"):
            rough = np.nan_to_num(self.x[queries] @ y.T, nan=np.inf)
            slack = 1e-12 * self.length[queries][:, None] * length  # a rough product lies that near to the exact one
            i, j = np.nonzero(~(rough < self.floor[queries][:, None] - slack))
        for at in range(0, len(i), PAIRS):
            a, b = queries[i[at : at + PAIRS]], j[at : at + PAIRS]
            score = products(self.x[a], y[b])
            self._merge(a, place[b], score, least[b])

    def _merge(self, query: np.ndarray, place: np.ndarray, score: np.ndarray, least: np.ndarray) -> None:
        query, place, score, least = (np.concatenate(c) for c in ((self.query, query), (self.place, place), (self.score, score), (self.least, least)))
        order = np.lexsort((least, -score, query))
        query, place, score, least = query[order], place[order], score[order], least[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        use = nth < self.k
        self.query, self.place, self.score, self.least = query[use], place[use], score[use], least[use]
        full = np.flatnonzero(nth[use] == self.k - 1)
        self.floor[self.query[full]] = self.score[full]


def least_ids(ids: list[list[int | None]]) -> np.ndarray:
    """The first id of each class as a number to break ties by; null after all others."""
    return np.array([np.inf if x[0] is None else x[0] for x in ids], float)


def _placed(sent, budget: float, k: int, kind: str):
    """Classes to rows of the subtrees: each as a base row in every tree (role 0), and where it is asked for as a query with the leaves it visits (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = sent.value
        low = min(SUBTREE, forest.levels)
        names = ["tree", "node", "role", "rep", "vec", "ids", "leaves"]
        for batch in batches:
            x = matrix(batch.column("vec").to_pylist(), kind)
            leaf = forest.leaves(x)
            own = pa.array([v.tobytes() for v in leaf.T.astype("<i4")], pa.binary())
            for t in range(len(leaf)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf[t] >> low), pa.array(np.zeros(len(x), np.int32)), batch.column("rep"), batch.column("vec"), batch.column("ids"), own], names=names)
            asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            rows: list[tuple[int, int, int, bytes]] = []
            for i, query in zip(asked, forest.lifted(x[asked], query=True), strict=True):
                of: dict[tuple[int, int], list[int]] = {}
                for t, place in forest.chosen(query, budget, k):
                    of.setdefault((t, place >> low), []).append(place)
                rows += [(t, node, i, np.array(places, "<i4").tobytes()) for (t, node), places in of.items()]
            if rows:
                t, node, i, places = zip(*rows, strict=True)
                at, n = pa.array(i), len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(node, pa.int64()), pa.array(np.ones(n, np.int32)), batch.column("rep").take(at), batch.column("vec").take(at), pa.nulls(n, pa.list_(pa.int64())), pa.array(places, pa.binary())], names=names)

    return run


PLACED = "tree int, node long, role int, rep long, vec binary, ids array<long>, leaves binary"


PARTIAL = "query long, reps array<long>, scores array<double>, ids array<array<long>>"
BEST = "query long, best array<struct<rep:long,id:long,score:double>>"


def _merged(k: int):
    """Partial results in order of query to the k + 1 best rows of each: classes found in several trees once, spelled out by key."""

    def ranked(found: dict[int, tuple[float, list]]) -> list[tuple[int, int | None, float]]:
        rows = [(-score, i is None, i or 0, rep) for rep, (score, ids) in found.items() for i in ids]
        return [(rep, None if gone else i, -score) for score, gone, i, rep in sorted(rows)[: k + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, {}
        kind = pa.list_(pa.struct([("rep", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            done: list[tuple[int, list]] = []
            for query, reps, scores, ids in zip(*(batch.column(c).to_pylist() for c in ("query", "reps", "scores", "ids")), strict=True):
                if query != now:
                    if now is not None:
                        done.append((now, ranked(found)))
                    now, found = query, {}
                found |= {r: (s, i) for r, s, i in zip(reps, scores, ids, strict=True)}
                if len(found) > 10_000:  # however many subtrees a query visits, only its best are held
                    best = {rep for rep, _, _ in ranked(found)}
                    found = {r: v for r, v in found.items() if r in best}
            if done:
                q, best = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([[dict(zip(("rep", "id", "score"), b, strict=True)) for b in x] for x in best], kind)], names=["query", "best"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([[dict(zip(("rep", "id", "score"), b, strict=True)) for b in ranked(found)]], kind)], names=["query", "best"])

    return run


def _compare(k: int, kind: str):
    names = [c.split()[0] for c in PARTIAL.split(", ")]

    def met(tree: int, base: list, queries: list) -> Iterator[pa.RecordBatch]:
        rep, vec, ids, leaves = zip(*base, strict=True)
        leaf = np.array([np.frombuffer(b, "<i4")[tree] for b in leaves])
        order = np.argsort(leaf, kind="stable")
        y, least, rep, leaf = matrix(list(vec), kind)[order], least_ids(list(ids))[order], np.array(rep)[order], leaf[order]
        length = norms(y)
        for at in range(0, len(queries), BLOCK):
            q_rep, q_vec, _, q_leaves = zip(*queries[at : at + BLOCK], strict=True)
            visits = [np.frombuffer(b, "<i4") for b in q_leaves]
            of, asked = np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate(visits)
            best = Best(matrix(list(q_vec), kind), k + 1)
            for place in np.unique(asked):
                a, b = np.searchsorted(leaf, [place, place + 1])
                if a < b:
                    best.add(of[asked == place], y[a:b], length[a:b], np.arange(a, b), least[a:b])
            asks, begin = np.unique(best.query, return_index=True)  # one row a query: its best here, side by side
            if len(asks):
                offsets = pa.array(np.append(begin, len(best.query)), pa.int32())
                columns = pa.array(rep[best.place]), pa.array(best.score), pa.array([ids[order[p]] for p in best.place], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(q_rep)[asks]), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, queries = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "salt", "role")), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("rep", "vec", "ids", "leaves")), strict=True)
            for (*key, role), row in zip(keys, rows, strict=True):
                if now != key:
                    if base and queries:
                        yield from met(now[0], base, queries)
                    now, base, queries = key, [], []
                (base, queries)[role].append(row)
                if len(queries) >= 4096:  # queries pass by in blocks; only a subtree's base is held
                    if base:
                        yield from met(now[0], base, queries)
                    queries = []
        if base and queries:
            yield from met(now[0], base, queries)

    return run


def _scan(sent, k: int, kind: str):
    """The k best classes of all the task's rows for each of a few queries, with their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value, k)
        held: list[bytes] = []
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            y = matrix(raw, kind)
            best.add(np.arange(len(best.x)), y, norms(y), len(held) + np.arange(len(raw)), least_ids(batch.column("ids").to_pylist()))
            held += raw
            used, best.place = np.unique(best.place, return_inverse=True)
            held = [held[p] for p in used]
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(best.query.astype(np.int32)), pa.array(best.score), pa.array([held[p] for p in best.place], pa.binary())], names=["query", "score", "vec"])

    return run


def set_budget(classes: DataFrame, forest: Forest, k: int, kind: str, wanted: float = WANTED, tried: int = TRIED) -> float:
    """Candidates that a queue has to give, with repeats, so that a share of `wanted` of the true neighbours of about `tried` queries is among them."""
    spark = classes.sparkSession
    sample = [r["vec"] for r in sorted(drawn(classes.filter("asked").select("vec"), tried, F.col("vec")).collect(), key=lambda r: r["h"])]
    if not sample:
        return 0.0
    x = matrix(sample, kind)
    found = classes.select("vec", "ids").mapInArrow(_scan(spark.sparkContext.broadcast(x), k + 1, kind), "query int, score double, vec binary")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    near = found.withColumn("nth", nth).filter(F.col("nth") <= k + 1).collect()
    leaf = forest.leaves(matrix([r["vec"] for r in near], kind))
    needs: list[int] = []
    for q, query in enumerate(forest.lifted(x, query=True)):
        own = [j for j, r in enumerate(near) if r["query"] == q and r["vec"] != sample[q]]
        open_, held, at = set(own), 0, {}
        for j in own:
            for t in range(len(leaf)):
                at.setdefault((t, int(leaf[t, j])), []).append(j)
        for place in forest.visits(query):
            held += int(forest.sizes[place])
            for j in at.get(place, ()):
                if j in open_:
                    open_.discard(j)
                    needs.append(held)
            if not open_:
                break
    return float(np.quantile(needs, wanted, method="higher")) if needs else 0.0


RESULT = "query_id long, rank int, vec_id long, score double"


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", embedding: str = "embedding", budget: float | None = None, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every` the k others found of largest inner product.

    Scores are exact doubles; of equal ones the least key comes first, a null key last. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do those of another length than most have (of ties the
    longer). Rows of equal key and vector count once; rows of equal key and different vectors are candidates and queries
    of their own. Equal vectors are one class in the search, of which the k + 1 least keys are all that a result can
    hold. Null keys aren't queries. budget: candidates a query's queue gives; None measures how many are needed, infinity compares all
    rows (the exact way). Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = _valid(vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e")), kind)
    d = usual_length({r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()})
    if not d:
        return spark.createDataFrame([], RESULT)
    asked = F.coalesce(F.col("id") % every == 0, F.lit(False))
    once = settle(rows.filter(F.col("d") == d).groupBy("vec", "id").agg(F.max("norm").alias("norm")).withColumn("asked", asked))
    # the least keys of a vector, apart for those that ask: a bounded number of rows whatever the vector's share of the table
    few = once.withColumn("nth", F.row_number().over(Window.partitionBy("vec", "asked").orderBy(F.asc_nulls_last("id")))).filter(F.col("nth") <= k + 1)
    in_order = F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("gone"), "id")))
    grouped = few.groupBy("vec").agg(F.slice(F.transform(in_order, lambda s: s["id"]), 1, k + 1).alias("ids"), F.bool_or("asked").alias("asked"), F.max("norm").alias("norm"))
    classes = settle(grouped.select(F.monotonically_increasing_id().alias("rep"), "vec", "ids", "asked", "norm"))
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).first()
    sample = sorted(drawn(classes.select("vec"), SAMPLE, F.col("vec"), n=total["n"]).collect(), key=lambda r: r["h"])
    levels = int(np.clip(np.ceil(np.log2(max(total["n"], 1) / leaf)), 0, MOST_LEVELS))
    forest = Forest(matrix([r["vec"] for r in sample], kind), min(total["most"], 1e300), levels, trees)
    sent = spark.sparkContext.broadcast(forest)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        sizes = np.zeros_like(f.sizes)
        for batch in batches:
            for t, own in enumerate(f.leaves(matrix(batch.column("vec").to_pylist(), kind))):
                sizes[t] += np.bincount(own, minlength=sizes.shape[1])
        t, place = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(place), pa.array(sizes[t, place])], names=["tree", "leaf", "n"])

    for r in classes.select("vec").mapInArrow(counted, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        forest.sizes[r["tree"], r["leaf"]] = r["n"]
    if budget is None:
        budget = set_budget(classes, forest, k, kind)
    sent = spark.sparkContext.broadcast(forest)
    placed = settle(classes.select("rep", "vec", "ids", "asked").mapInArrow(_placed(sent, budget, k, kind), PLACED))
    n = shuffle_count(spark)
    found = dealt(placed, n, ("tree", "node"), TASK_PAIRS).mapInArrow(_compare(k, kind), PARTIAL)
    top = found.repartition(n, "query").sortWithinPartitions("query").mapInArrow(_merged(k), BEST)
    of = classes.filter("asked").select(F.col("rep").alias("query"), "vec").join(settle(top), "query").select("vec", F.col("query").alias("own"), "best")
    others = F.filter("best", lambda b: ~((b["rep"] == F.col("own")) & b["id"].eqNullSafe(F.col("id"))))
    ranked = once.filter("asked").select("id", "vec").join(of, "vec").select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
    forget(placed)
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all embeddings."""
    from .common import table

    return neighbours(table(spark, sf_dir, "embeddings"))
