"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_rows, pieces, settle, texts
from .words import grams, hashes, split

STATISTICS = (
    "words", "word_length", "word_length_spread", "distinct_words", "distinct_pairs", "repeats_before", "upper", "digits", "symbols",
    "bars", "marks", "other_bytes", "sentence_ends", "words_a_line", "distinct_lines", "longest_word",
)
N = len(STATISTICS)
#: Weight of the pooled covariance in each class's, and of its diagonal in that.
TO_POOLED, TO_DIAGONAL = 0.1, 0.02


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int8)
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
    kind[[ord(c) for c in ".,;:?'\"-()"]] = 0
    kind[range(65, 91)] = 1
    kind[range(48, 58)] = 2
    kind[ord("|")] = 4
    kind[ord("!")] = 5
    kind[128:] = 6
    return kind


KIND = _classes()


def distinct_share(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Share of distinct values among those of each row; 1 where there are none."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    n = np.bincount(r, minlength=rows)
    return np.where(n > 0, np.bincount(r[new], minlength=rows) / np.maximum(n, 1), 1.0)


def statistics(raw: list[bytes]) -> np.ndarray:
    """Transformed statistics, a row for each text: logarithms of counts, arcsines of roots of shares."""
    w, rows = split(raw), len(raw)
    h = hashes(w)
    size = (w.end - w.start).astype(float)
    n = np.bincount(w.doc, minlength=rows).astype(float)
    some = np.maximum(n, 1)
    mean = np.bincount(w.doc, size, rows) / some
    spread = np.sqrt(np.maximum(0, np.bincount(w.doc, size**2, rows) / some - mean**2))
    longest = np.zeros(rows)
    np.maximum.at(longest, w.doc, size)
    pair = grams(h, 2)
    same_row = w.doc[:-1] == w.doc[1:]
    before = same_row & (h[:-1] == h[1:]) if len(h) else same_row
    at = np.concatenate([[0], np.cumsum(w.buffer == 10)[:-1]])
    kinds = np.bincount(at * 8 + KIND[w.buffer], minlength=8 * rows).reshape(rows, 8).astype(float)
    chars = np.maximum(kinds.sum(axis=1) - 1, 1)
    ends = np.isin(w.buffer[w.end - 1], np.frombuffer(b".!?", np.uint8)) if len(h) else np.zeros(0, bool)
    lines = [x.split(b"\n") for x in raw]
    line_n = np.array([len(x) for x in lines], float)
    share = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread),
        share(distinct_share(w.doc, h, rows)) * np.minimum(1, n / 20), share(distinct_share(w.doc[:-1][same_row], pair[same_row], rows)),
        share(np.bincount(w.doc[:-1][before], minlength=rows) / some),
        *(share(kinds[:, k] / chars) for k in (1, 2, 3, 4, 5, 6)),
        share(np.bincount(w.doc[ends], minlength=rows) / some), np.log1p(n / line_n),
        share(np.array([len(set(x)) for x in lines]) / line_n), np.log1p(longest),
    ])


def features(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The columns `keys` and x, the statistics of each row's whole text."""
    given = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "__text", 1 << 20):
            x = statistics(texts(part.column("__text")))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], rows], names=[*keys, "x"])

    return map_rows(given, run, f"{kinds}, x array<double>")


@dataclass
class Model:
    """Class 0 and 1: log prior less half the log determinant, mean, inverse Cholesky factor of the covariance."""

    offset: list[float]
    mean: list[np.ndarray]
    whiten: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        log = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for o, m, w in zip(self.offset, self.mean, self.whiten, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of x for each class y (0 or 1); each task sends one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((N + 1, N + 1)), 1: np.zeros((N + 1, N + 1))}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, N)
            x = np.column_stack([np.ones(len(x)), x])
            y = batch.column("y").to_numpy()
            for k, t in total.items():
                t += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0].ravel(), total[1].ravel()], pa.list_(pa.float64()))], names=["y", "m"])

    parts = rows.select("x", "y").mapInArrow(run, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v"))
    sums = parts.groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (N + 1) ** 2 rows
    out = {k: np.zeros((N + 1) ** 2) for k in (0, 1)}
    for r in sums:
        out[r["y"]][r["i"]] = r["v"]
    return {k: (m[0], m.reshape(N + 1, N + 1)[0, 1:], m.reshape(N + 1, N + 1)[1:, 1:]) for k, m in out.items()}


def fit(of: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """From the classes' moments. A class without rows gets the pooled mean and covariance."""
    n = sum(m[0] for m in of.values())
    pooled_mean = (of[0][1] + of[1][1]) / max(n, 1)
    cov, mean = {}, {}
    for k, (c, s, q) in of.items():
        mean[k] = s / c if c else pooled_mean
        cov[k] = q / c - np.outer(mean[k], mean[k]) if c else np.zeros((N, N))
    within = sum(of[k][0] * cov[k] for k in of) / max(n, 1) + 1e-6 * np.eye(N)
    pooled = (1 - TO_DIAGONAL) * within + TO_DIAGONAL * np.diag(np.diag(within))
    model = Model([], [], [])
    for k in (0, 1):
        own = (1 - TO_POOLED) * cov[k] + TO_POOLED * pooled if of[k][0] else pooled
        factor = np.linalg.cholesky(own + 1e-6 * np.eye(N))
        model.offset.append(float(np.log((of[k][0] + 1) / (n + 2)) - np.log(np.diag(factor)).sum()))
        model.mean.append(mean[k])
        model.whiten.append(np.linalg.inv(factor))
    return model


def score(rows: DataFrame, model: Model, *keys: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = sent.value.scores(batch.column("x").flatten().to_numpy().reshape(-1, N))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], names=[*keys, "score"])

    return map_rows(rows.select(*keys, "x"), run, f"{kinds}, score double")


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a row is kept from training: by the CRC-32 of its id as text; a null id is not held out and never labelled."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """Fit on all rows (key, x) with a label outside the held-out fold; null labels are left out."""
    known = labels.select(F.col(key), F.col("quality").alias("y")).filter("y in (0, 1)").filter(~held_out(key))
    return fit(moments(rows.select(key, "x").join(known, key)))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, held_out, score (likelihood of label 1) and predicted (1 from a score of 0.5).

    Null and empty texts are scored by the statistics of an empty text. Repeated rows are scored alike, and a label
    counts once for each row of its document. Without any labels every score is 0.5. Labels, source, language and other
    columns are never inputs of a score, whatever their names.
    """
    rows = settle(features(docs, key))
    got = score(rows, train(rows, labels, key), key)
    return got.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, that the classifier does not reject; null and empty texts are judged as empty ones.

    Texts are read once: each row is written with its statistics, and the model from the labelled ones filters those.
    """
    x = fresh("x", docs)
    columns = docs.columns

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, text, 1 << 20):
            v = statistics(texts(part.column(text)))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * N), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*columns, x])

    kinds = T.StructType([*docs.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])
    rows = settle(map_rows(docs, measure, kinds))
    sent = docs.sparkSession.sparkContext.broadcast(train(rows.select(key, F.col(x).alias("x")), labels, key))

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        good = sent.value.scores(batch.column(x).flatten().to_numpy().reshape(-1, N)) >= 0.5
        yield batch.filter(pa.array(good)).select(columns)

    return map_rows(rows, judge, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all whole documents, learned from the labelled rows outside the held-out third."""
    from .common import table

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
