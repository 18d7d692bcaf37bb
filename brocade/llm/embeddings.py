"""Near-duplicate embeddings by product quantisation.

Unit vectors are assigned to the nearest of some coarse centroids; their residuals are coded by sub-vector. A vector
searches the lists of its nearest centroids: table look-ups give its distance to each coded vector there, and the pair
stays unless that distance, less the coded vector's own coding error, shows that the cosine can't reach the threshold.
What stays is ranked by the exact cosine. Vectors of equal bytes are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drawn, forest, forget, map_rows, settle, shuffle_count

#: Vectors the centroids and codes are fitted to, at most; lists searched; sub-vectors and codes of each.
SAMPLE, PROBES, PARTS, CODES = 20_000, 12, 16, 256
#: Pairs of a list that one task compares and coded vectors that it holds, about; lists dealt over several tasks that are broadcast.
TASK_PAIRS, BASE_ROWS, MOST_BROADCAST = 4_000_000, 20_000, 100_000


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of c, nearest first."""
    out = np.empty((len(x), min(k, len(c))), np.int64)
    for at in range(0, len(x), 2048):
        d = (c**2).sum(axis=1) - 2 * x[at : at + 2048] @ c.T
        if out.shape[1] == 1:
            out[at : at + 2048, 0] = d.argmin(axis=1)
        else:
            part = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            order = np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable")
            out[at : at + 2048] = np.take_along_axis(part, order, 1)
    return out


@dataclass
class Index:
    """Lists are pairs of a first centroid and a second one, of the residuals that the first leaves; numbered as first * len(second) + second."""

    first: np.ndarray
    second: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    def centroids(self, place: np.ndarray | int) -> np.ndarray:
        return self.first[place // len(self.second)] + self.second[place % len(self.second)]

    def lists(self, x: np.ndarray, probes: int = PROBES) -> np.ndarray:
        """Places of the nearest lists, the home first: first centroids, the nearest second ones of each, and of these pairs the nearest."""
        one = nearest(x, self.first, probes)
        if len(self.second) == 1:
            return one
        r = (x[:, None] - self.first[one]).reshape(-1, x.shape[1])
        two = nearest(r, self.second, 4)
        far = ((r[:, None] - self.second[two]) ** 2).sum(axis=2).reshape(len(x), -1)
        place = (one[:, :, None] * len(self.second) + two.reshape(len(x), one.shape[1], -1)).reshape(len(x), -1)
        return np.take_along_axis(place, np.argsort(far, axis=1, kind="stable")[:, :probes], 1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit vectors in their lists, and the length of what the codes leave."""
        r = x - self.centroids(home)
        codes = np.stack([nearest(r[:, a:b], book, 1)[:, 0] for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1)
        left = sum(((r[:, a:b] - book[codes[:, m]]) ** 2).sum(axis=1) for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(left)

    def distances(self, q: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of query vectors to the coded vectors of a list, by table look-ups."""
        r = q - self.centroids(place)
        out = np.zeros((len(q), len(codes)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = ((r[:, None, a:b] - book[None]) ** 2).sum(axis=2).astype(np.float32)
            out += table[:, codes[:, m]]
        return out


def fit(sample: np.ndarray, rows: int, most: int = 4096, a_list: int = 4000) -> Index:
    """Centroids and sub-codes of residuals, from a bounded sample of unit vectors.

    First centroids are about as many as the root of the number of rows, `most` at most; where lists would then hold
    more than `a_list` rows, second ones divide them, so that a list's size doesn't grow with the table.
    """
    dim = sample.shape[1]
    lists = int(min(max(16, 2 ** round(np.log2(max(rows, 1)) / 2)), most, max(1, len(sample) // 4)))
    first = kmeans(sample, lists, 8, 1)
    r = sample - first[nearest(sample, first, 1)[:, 0]]
    divided = int(min(-(-rows // (len(first) * a_list)), most, max(1, len(sample) // 4)))
    second = kmeans(r, divided, 8, 101) if divided > 1 else np.zeros((1, dim))
    r = r - second[nearest(r, second, 1)[:, 0]]
    edges = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
    cuts = [(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]
    return Index(first, second, [kmeans(r[:, a:b], CODES, 6, 2 + m) for m, (a, b) in enumerate(cuts)], cuts)


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid_vectors(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    """(id, vec): vec is the vector's doubles as bytes, null where it can't have a cosine."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for x in batch.column("e").to_pylist():
            v = None if x is None or not len(x) or any(y is None for y in x) else np.array(x, "<f8")
            # a scale beyond the range of squares is brought back by its largest component
            out.append(None if v is None or not np.isfinite(v).all() or not v.any() else ((v / s if (s := np.abs(v).max()) > 1e150 or s < 1e-150 else v) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "vec"])

    return map_rows(rows.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e")), run, "id long, vec binary")


PLACED = "bytes int, list long, role int, rep long, size long, vec binary, codes binary, error double, probes binary, own long"
NAMES = [x.split()[0] for x in PLACED.split(", ")]


def _place(sent):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bytes_of = pc.binary_length(batch.column("vec")).to_numpy()
        for size in np.unique(bytes_of):
            yield from place(sent.value[int(size)], batch.filter(pa.array(bytes_of == size)))

    def place(index: Index, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            raw = part.column("vec").to_pylist()
            x = unit(raw)
            near = index.lists(x)
            codes, error = index.encode(x, near[:, 0])
            rep, size, n = part.column("rep"), part.column("size"), len(x)
            nothing = pa.nulls(n, pa.binary())
            long = pa.array(np.full(n, len(raw[0]), np.int32))
            probes = [row.astype("<i8").tobytes() for row in near]
            own = pa.array(near[:, 0], pa.int64())
            yield pa.RecordBatch.from_arrays([long, own, pa.array(np.zeros(n, np.int32)), rep, size, pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.binary()), own], names=NAMES)
            for p in range(near.shape[1]):
                yield pa.RecordBatch.from_arrays([long, pa.array(near[:, p], pa.int64()), pa.array(np.ones(n, np.int32)), rep, size, pa.array(raw, pa.binary()), nothing, pa.nulls(n, pa.float64()), nothing, own], names=NAMES)

    return run


def _search(sent, least: float):
    reach = np.sqrt(2 - 2 * least)
    names = ["kind", "a", "b"]

    def compare(index: Index, place: int, base: list, queries: list) -> Iterator[pa.RecordBatch]:
        rep, size, vec, codes, error, probes, _ = (list(c) for c in zip(*base, strict=True))
        rep, size, y = np.array(rep, np.int64), np.array(size, np.int64), unit(vec)
        codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(rep), -1)
        bound = (reach + 1e-4 + np.array(error)) ** 2 + 1e-4
        probes = np.stack([np.frombuffer(p, "<i8") for p in probes])
        back = np.zeros(len(rep), np.int64)
        ids, counts, left, right = [], [], [], []
        step = max(1, min(256, 2_000_000 // len(rep)))
        for at in range(0, len(queries), step):
            q_rep, q_size, q_vec, _, _, _, q_own = (list(c) for c in zip(*queries[at : at + step], strict=True))
            q_rep, q_size, q_own, x = np.array(q_rep, np.int64), np.array(q_size, np.int64), np.array(q_own), unit(q_vec)
            i, j = np.nonzero(index.distances(x, place, codes) <= bound)
            other = q_rep[i] != rep[j]
            i, j = i[other], j[other]
            good = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 100_000]], y[j[k : k + 100_000]]) >= least for k in range(0, len(i), 100_000)]) if len(i) else np.zeros(0, bool)
            i, j = i[good], j[good]
            ids.append(q_rep)
            counts.append(np.bincount(i, size[j], len(q_rep)).astype(np.int64))
            # the base vector finds the query by itself only if it searches the query's list
            unseen = ~(probes[j] == q_own[i, None]).any(axis=1)
            back += np.bincount(j[unseen], q_size[i[unseen]], len(rep)).astype(np.int64)
            u, v = forest(q_rep[i], rep[j])
            left.append(u)
            right.append(v)
        u, v = forest(np.concatenate(left), np.concatenate(right)) if left else (rep[:0], rep[:0])
        a = np.concatenate([*ids, rep, u])
        b = np.concatenate([*counts, back, v])
        kind = np.repeat(np.array([0, 1], np.int32), [len(a) - len(u), len(u)])
        use = (kind == 1) | (b > 0)
        yield pa.RecordBatch.from_arrays([pa.array(kind[use]), pa.array(a[use]), pa.array(b[use])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, queries = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in ("bytes", "list", "salt", "role")), strict=True)
            rows = zip(*(batch.column(k).to_pylist() for k in ("rep", "size", "vec", "codes", "error", "probes", "own")), strict=True)
            for (*key, role), row in zip(keys, rows, strict=True):
                if now != key:
                    if base and queries:
                        yield from compare(sent.value[now[0]], now[1], base, queries)
                    now, base, queries = key, [], []
                if role == 0:
                    base.append(row)
                else:
                    queries.append(row)
                    if len(queries) >= 4096:  # a list's queries pass by in blocks; only its base is held
                        if base:
                            yield from compare(sent.value[now[0]], now[1], base, queries)
                        queries = []
        if base and queries:
            yield from compare(sent.value[now[0]], now[1], base, queries)

    return run


def dealt(placed: DataFrame, n: int, key: tuple[str, str] = ("bytes", "list"), pairs: int | None = None) -> DataFrame:
    """Rows with the task they go to. A large list is a grid of blocks of its base and of its queries, each pair of blocks one task."""
    sizes = placed.groupBy(*key).agg(F.sum(1 - F.col("role")).alias("base"), F.sum("role").alias("queries"))
    across = F.greatest(F.lit(1), F.ceil(F.least("base", F.lit(BASE_ROWS)) * F.col("queries") / (pairs or TASK_PAIRS))).cast("int")
    grid = settle(sizes.select(*key, F.greatest(F.lit(1), F.ceil(F.col("base") / BASE_ROWS)).cast("int").alias("down"), across.alias("across")).filter("down * across > 1"))
    gridded = placed.join(F.broadcast(grid) if grid.count() <= MOST_BROADCAST else grid, list(key), "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("down", "across")})
    row, column = F.pmod("rep", F.col("down")).cast("int"), F.pmod("rep", F.col("across")).cast("int")
    to_all = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda c: row * F.col("across") + c)
    from_all = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda r: r * F.col("across") + column)
    return gridded.withColumn("salt", F.explode(F.when(F.col("role") == 0, to_all).otherwise(from_all))).drop("down", "across").repartition(n, *key, "salt").sortWithinPartitions(*key, "salt", "role")


def embedding_groups(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: key, n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors link with those
    of equal length only, so each length has an index and lists of its own; lengths are few. Repeated rows are vectors
    of their own, linked by cosine 1. A null key is never a component_id unless all of its component have null keys.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    n = shuffle_count(spark)
    rows = settle(valid_vectors(vectors, key, embedding))
    usable = F.col("vec").isNotNull()
    grouped = rows.filter(usable).groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = settle(grouped.select(F.xxhash64("vec", F.col("least")).alias("rep"), "least", "size", "vec"))
    lengths = {r["bytes"]: r["n"] for r in classes.groupBy(F.length("vec").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not lengths:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    indexes = {}
    for size, count in lengths.items():
        sample = drawn(classes.filter(F.length("vec") == size).select("vec"), SAMPLE, F.col("vec"), n=count).collect()
        indexes[size] = fit(unit([r["vec"] for r in sorted(sample, key=lambda r: r["h"])]), count)
    sent = spark.sparkContext.broadcast(indexes)
    placed = settle(map_rows(classes.select("rep", "size", "vec"), _place(sent), PLACED))
    found = settle(dealt(placed, n).mapInArrow(_search(sent, least), "kind int, a long, b long"))
    forget(placed)
    links = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(roots, "rep", "left").join(links, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = settle(named.select("vec", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    forget(found, classes)
    of = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("vec", "n_links", "component_id")
    linked = rows.filter(usable).join(of, "vec").select("id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at cosine 0.95 or more."""
    from .common import table

    return embedding_groups(table(spark, sf_dir, "embeddings"))


