"""Toxicity: a classifier chain of linear models over hashed words, word beginnings and the marks on words.

The chain takes any list of 0/1 columns of a table of labels, the earlier ones as inputs of the later ones. The given
tables have two, of which `toxic` is last and `quality` comes before it. Each model sees the hashed features and the
earlier categories' probabilities: in training those that models predict which have seen neither the row nor, in
choosing their features, its label; in scoring those of the full models.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, map_rows, pieces, settle, texts
from .quality import held_out
from .words import Words, hashes, split

SIZE = 1 << 18
PREFIXES = (4, 5, 6)
CATEGORIES = ("quality", "toxic")
#: Labelled rows of each class of the last category and features kept of each category, about, at most; folds.
SAMPLE, FEATURES, FOLDS = 6000, 2000, 3
#: Standard errors that a feature's log odds ratio must differ from zero by.
LEAST_Z = 3.0
_FOLD = bytes([*range(65), *range(97, 123), *range(91, 256)])
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def word_ids(word: bytes) -> tuple[int, ...]:
    """Features of the whole word, its beginnings and the marks after it (-1 where there are none): A-Z lower-cased, ASCII marks at the edges off."""
    w = word.translate(_FOLD).strip(_MARKS)
    t = w.decode("utf-8", "ignore")
    after = word[len(word.rstrip(_MARKS)) :]
    begin = (zlib.crc32(f"^{t[:n]}".encode()) % SIZE if len(t) > n else -1 for n in PREFIXES)
    return (zlib.crc32(w) % SIZE if w else -1), *begin, (zlib.crc32(b"$" + after) % SIZE if after else -1)


def doc_features(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a batch, of the kept features only."""
    _, first, place = np.unique(hashes(w), return_index=True, return_inverse=True)
    raw = w.buffer.tobytes()
    ids = np.array([word_ids(raw[a:b]) for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], np.int64).reshape(-1, 2 + len(PREFIXES))
    good = ids >= 0
    if keep is not None:
        good &= keep[np.maximum(ids, 0)]
    pairs = [w.doc[at] * SIZE + ids[place[at], k] for k in range(ids.shape[1]) if len(at := np.flatnonzero(good[place, k]))]
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // SIZE, both % SIZE


@dataclass
class Linear:
    """Weights of kept features, a bias and weights of the earlier categories' probabilities (less one half)."""

    weights: np.ndarray
    bias: float
    earlier: np.ndarray

    def probability(self, rows: np.ndarray, ids: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.weights[ids], n) + self.bias + (before - 0.5) @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(rows: np.ndarray, ids: np.ndarray, n: int, before: np.ndarray, y: np.ndarray, size: int, rounds: int = 80, ridge: float = 1.0) -> Linear:
    """Ridge-penalised logistic regression of sparse binary features and dense earlier probabilities, by adaptive gradient steps."""
    model = Linear(np.zeros(size), 0.0, np.zeros(before.shape[1]))
    sw, sb, se = np.full(size, 1e-6), 1e-6, np.full(before.shape[1], 1e-6)
    for _ in range(rounds):
        miss = y - model.probability(rows, ids, n, before)
        g = np.bincount(ids, miss[rows], size) - ridge * model.weights
        gb, ge = miss.sum(), (before - 0.5).T @ miss - ridge * model.earlier
        sw, sb, se = sw + g * g, sb + gb * gb, se + ge * ge
        model.weights += 0.5 * g / np.sqrt(sw)
        model.bias += 0.5 * gb / np.sqrt(sb)
        model.earlier += 0.2 * ge / np.sqrt(se)
    return model


@dataclass
class ChainModel:
    """keep: which hashed features are used; number: their place in the models' weights."""

    categories: tuple[str, ...]
    keep: np.ndarray
    number: np.ndarray
    models: list[Linear]

    def probabilities(self, raw: list[bytes]) -> np.ndarray:
        w = split(raw)
        rows, ids = doc_features(w, self.keep) if len(w.start) else (np.zeros(0, np.int64),) * 2
        before = np.zeros((len(raw), 0))
        for m in self.models:
            before = np.column_stack([before, m.probability(rows, self.number[ids], len(raw), before)])
        return before


def fit_chain(rows: np.ndarray, ids: np.ndarray, n: int, targets: np.ndarray, fold: np.ndarray, used: np.ndarray, linked: bool = True) -> list[Linear]:
    """One model for each column of targets; those after the first also see out-of-fold probabilities of the earlier ones.

    used[c, k] tells which features model c may use when fold k is left out, used[c, FOLDS] when none is. Models see
    one half for every earlier category if `linked` is off, which is no chain.
    """
    models, before = [], np.zeros((n, 0))
    for c in range(targets.shape[1]):
        y, size = targets[:, c].astype(float), used.shape[2]
        own = used[c, FOLDS][ids]
        models.append(logistic(rows[own], ids[own], n, before, y, size))
        out = np.full(n, 0.5)
        for k in range(FOLDS) if linked and c + 1 < targets.shape[1] else ():
            here = fold == k
            if not here.any() or here.all():
                continue
            place = np.cumsum(~here) - 1
            may = used[c, k][ids]
            at = may & ~here[rows]
            part = logistic(place[rows[at]], ids[at], int((~here).sum()), before[~here], y[~here], size)
            out[here] = part.probability(rows[may], ids[may], n, before)[here]
        before = np.column_stack([before, out])
    return models


def sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, fold, ids): labels and features of about SAMPLE labelled rows of each class of the last category outside the held-out fold.

    Rows are those whose id hash lies below a threshold set from the class's size. Of label rows of one id the greatest
    counts, and of document rows of one id the least text, so repeats don't make the sample larger.
    """
    last = categories[-1]
    y = F.array(*[F.col(c).cast("int") for c in categories])
    known = labels.filter(F.col(key).isNotNull() & ~held_out(key)).filter(F.forall(y, lambda v: v.isNotNull() & v.isin(0, 1)))
    known = known.select(F.col(key).alias("__key"), y.alias("y"), F.col(last).cast("int").alias("class"))
    sizes = {r["class"]: r["n"] for r in known.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    near = F.lit(False)
    hashed = known.withColumn("h", F.xxhash64(F.col("__key").cast("string"), F.lit("toxic")))
    for of, n in sizes.items():
        near = near | ((F.col("class") == of) & (hash_share("h") < SAMPLE / n))
    fold = F.pmod(F.col("h"), F.lit(FOLDS)).cast("int")
    chosen = F.broadcast(hashed.filter(near).groupBy("__key", fold.alias("fold")).agg(F.max("y").alias("y")))  # 2 * SAMPLE rows
    given = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(chosen, "__key").groupBy("__key", "y", "fold").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", 1 << 20):
            w = split(texts(part.column("text")))
            rows, ids = doc_features(w) if len(w.start) else (np.zeros(0, np.int64),) * 2
            cut = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("y").cast(pa.list_(pa.int32())), part.column("fold"), pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32)))], names=["y", "fold", "ids"])

    return map_rows(given.select("y", "fold", "text"), run, "y array<int>, fold int, ids array<int>")


def strengths(rows: DataFrame, categories: tuple[str, ...]) -> dict[tuple[int, int], list[int]]:
    """By (category, fold left out; FOLDS for none) the up to FEATURES features whose log odds ratio differs most from zero, chosen without that fold's labels."""
    parts = [(c, k) for c in range(len(categories)) for k in range(FOLDS + 1)]
    here = lambda c, v, k: ((F.element_at("y", c + 1) == v) & (F.col("fold") != k)).cast("int")
    sums = [F.sum(here(c, v, k)).alias(f"n{c}_{v}_{k}") for c, k in parts for v in (0, 1)]
    whole = rows.agg(*sums).first()
    total = {(c, k): tuple(whole[f"n{c}_{v}_{k}"] or 0 for v in (1, 0)) for c, k in parts}
    judged = [of for of, n in total.items() if all(n)]
    if not judged:
        return {of: [] for of in parts}
    zs = []
    for c, k in judged:
        a, b = (F.col(f"n{c}_{v}_{k}") + 0.5 for v in (1, 0))
        p, q = total[c, k]
        zs.append((F.log(a / (p + 1)) - F.log(b / (q + 1))) / F.sqrt(1 / a + 1 / b))
    far = F.greatest(*[F.abs(z) for z in zs], F.lit(0.0)) >= LEAST_Z
    found = rows.withColumn("id", F.explode("ids")).groupBy("id").agg(*sums).filter(far).select("id", F.array(*zs).alias("z")).collect()  # SIZE rows at most
    ids = np.array([r["id"] for r in found], np.int64)
    z = np.abs(np.array([r["z"] for r in found]).reshape(len(found), len(judged)))
    out = {of: [] for of in parts}
    for j, of in enumerate(judged):
        best = np.lexsort((ids, -z[:, j]))[:FEATURES]
        out[of] = ids[best[z[best, j] >= LEAST_Z]].tolist()
    return out


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, key: str = "doc_id", text: str = "text", linked: bool = True) -> ChainModel:
    """The chain fitted to a bounded sample. Without labelled rows every probability is one half."""
    rows = settle(sample(docs, labels, categories, key, text))
    best = strengths(rows, categories)
    kept = np.array(sorted({i for ids in best.values() for i in ids}), np.int64)
    keep, number = np.zeros(SIZE, bool), np.zeros(SIZE, np.int64)
    keep[kept], number[kept] = True, np.arange(len(kept))
    used = np.zeros((len(categories), FOLDS + 1, max(1, len(kept))), bool)
    for (c, k), ids in best.items():
        used[c, k, number[ids]] = True
    own = F.array_intersect("ids", F.array(*[F.lit(int(i)) for i in kept]).cast("array<int>"))
    small = rows.select("y", "fold", F.array_sort(own).alias("ids")).collect()  # 2 * SAMPLE rows of kept features
    small = sorted(small, key=lambda r: (r["fold"], r["y"], r["ids"]))
    n = len(small)
    row = np.repeat(np.arange(n), [len(r["ids"]) for r in small])
    ids = number[np.array([i for r in small for i in r["ids"]], np.int64)]
    targets = np.array([r["y"] for r in small]).reshape(n, len(categories))
    return ChainModel(categories, keep, number, fit_chain(row, ids, n, targets, np.array([r["fold"] for r in small]), used, linked))


def toxicity(docs: DataFrame, model: ChainModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, p_ and the name of each earlier category, score (the last one's probability) and predicted (1 from 0.5).

    Null and empty texts have no features and get the models' base rates. Repeated rows are scored alike. Other columns
    are not read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.schema[key].dataType.simpleString()
    scores = [*(f"p_{c}" for c in model.categories[:-1]), "score"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", 1 << 20):
            p = sent.value.probabilities(texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k]) for k in range(len(scores)))], names=[key, *scores])

    got = map_rows(docs.select(F.col(key), F.col(text).alias("text")), run, f"`{key}` {own}, " + ", ".join(f"{c} double" for c in scores))
    return got.select(key, held_out(key).alias("held_out"), *scores, (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all whole documents, learned from labelled rows outside the held-out third."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
