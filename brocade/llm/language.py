"""Language of words and documents: a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and its place in learned lexicons (the whole word); moves
between languages have learned weights. Forward-backward labels the words of code-switched text, and a document's
language is the one with the largest share of its letters. Chains are lines of text cut into runs of words, of equal
length, so that all runs of a batch are labelled together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, hash_share, map_rows, pieces, texts
from .quality import held_out
from .words import Words, hashes, split

SIZE = 1 << 18
CHAIN = 64
#: Documents trained on in each language, at most, words taken from each, from a random place in it, and languages.
SAMPLE_DOCS, SAMPLE_WORDS, MOST_LANGS = 800, 160, 200
UNKNOWN = "und"


def has_letter(word: bytes) -> int:
    """Letters of a word."""
    return sum(c.isalpha() for c in word.decode("utf-8", "replace"))


#: Bytes that are ASCII letters, and those that lead a character beyond ASCII, which nearly always is one.
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
EDGE_MARKS = np.zeros(256, bool)
EDGE_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of distinct words one after the other, and where each word's begin. ASCII marks at the edges go, A-Z is lower-cased."""
    bare = [w.translate(_FOLD).strip(_MARKS) for w in words]
    buffer = np.frombuffer(b"\x01" + b"\x02\x01".join(bare) + b"\x02", np.uint8).astype(U64)
    size = np.array([len(w) + 2 for w in bare], np.int64)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(bare)), size)
    place = np.arange(len(buffer)) - start[of]
    ids, rows = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(buffer), U64)
        for n in range(1, 7):  # n-grams with the edges; those at an edge are the affixes
            m = len(buffer) - n + 1
            if m <= 0:
                break
            h = h[:m] * U64(0x100000001B3) + buffer[n - 1 :] + U64(1)
            if n == 1:
                continue
            whole = place[:m] + n <= size[of[:m]]
            edge = (place[:m] == 0) | (place[:m] + n == size[of[:m]])
            keep = whole & edge if n > 4 else whole
            ids.append(((h[keep] * U64(0x9E3779B97F4A7C15)) >> U64(64 - 18)).astype(np.int64))
            rows.append(of[:m][keep])
    lexicon = np.array([zlib.crc32(b"word " + w) % SIZE for w in bare], np.int64)
    ids.append(lexicon)
    rows.append(np.arange(len(bare)))
    ids, rows = np.concatenate(ids), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return ids[order], np.searchsorted(rows[order], np.arange(len(bare)))


_FOLD = bytes(LOWER)
_MARKS = bytes(np.flatnonzero(EDGE_MARKS).astype(np.uint8))


@dataclass
class Chain:
    """Languages, a weight of each feature for each, weights of moves and of the first word."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        ids, first = word_features(words)
        n = np.diff(np.append(first, len(ids)))
        return np.add.reduceat(self.weights[ids], first, axis=0) / np.sqrt(n)[:, None]

    def forward_backward(self, scores: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of runs (runs, CHAIN, languages), expected moves, expected first labels and log totals; words that aren't real are passed over."""
        runs, length, k = scores.shape
        top = scores.max(axis=2, keepdims=True)
        e = np.where(real[:, :, None], np.exp(scores - top), 1.0)
        move, begin = np.exp(self.moves), np.exp(self.begin)
        alpha, norm = np.empty_like(e), np.ones((runs, length))
        a = begin * e[:, 0]
        for t in range(length):
            if t:
                a = np.where(real[:, t, None], (a @ move) * e[:, t], a)
            norm[:, t] = a.sum(axis=1)
            a = a / norm[:, t, None]
            alpha[:, t] = a
        beta = np.ones((runs, k))
        post = np.empty_like(e)
        expected = np.zeros((k, k))
        for t in range(length - 1, -1, -1):
            post[:, t] = alpha[:, t] * beta
            if t:
                here = e[:, t] * beta / norm[:, t, None]
                r = real[:, t]
                expected += (alpha[r, t - 1].T @ here[r]) * move
                beta = np.where(r[:, None], here @ move.T, beta)
        post /= post.sum(axis=2, keepdims=True)
        return post, expected, post[:, 0].sum(axis=0), np.log(norm).sum(axis=1)


def runs_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its run and place there, and the row of each run: every row cut into runs of CHAIN words."""
    at = np.arange(len(w.doc)) - w.first[w.doc]
    new = at % CHAIN == 0
    run = np.cumsum(new) - 1
    return run, at % CHAIN, w.doc[new]


def fit(samples: dict[str, list[bytes]], rounds: int = 40, least: float = 0.001) -> Chain:
    """By gradient ascent on the likelihood of word labels, until a round gains less than `least` a word; runs switch language now and then, as code-switched text does."""
    langs = sorted(samples)
    k = len(langs)
    model = Chain(langs, np.zeros((SIZE, k)), np.log(np.full((k, k), 0.02 / max(1, k - 1)) + np.eye(k) * 0.98), np.zeros(k))
    rng = np.random.default_rng(5)
    streams = []
    for i, lang in enumerate(langs):
        words = [x for t in samples[lang] for x in t.split()]
        streams += [(i, words[j : j + 16]) for j in range(0, len(words), 16)]
    order = rng.permutation(len(streams))
    group: list[list] = [[], []]
    rows = []
    follow = sorted(range(len(order)), key=lambda j: (j // 24, streams[order[j]][0], j))  # mostly of one language, some switches
    for j in follow:
        lang, words = streams[order[j]]
        group[0] += words
        group[1] += [lang] * len(words)
        while len(group[0]) >= CHAIN:
            rows.append((group[0][:CHAIN], group[1][:CHAIN]))
            group = [group[0][CHAIN:], group[1][CHAIN:]]
    if group[0]:
        rows.append(tuple(group))
    if not rows:
        return model
    vocabulary = {x: i for i, x in enumerate(dict.fromkeys(x for r, _ in rows for x in r))}
    ids, first = word_features(list(vocabulary))
    n = np.diff(np.append(first, len(ids)))
    scale = np.repeat(1 / np.sqrt(n), n)
    owner = np.repeat(np.arange(len(n)), n)
    index, gold, real = np.zeros((len(rows), CHAIN), np.int64), np.zeros((len(rows), CHAIN), np.int64), np.zeros((len(rows), CHAIN), bool)
    for r, (words, own) in enumerate(rows):
        index[r, : len(words)] = [vocabulary[x] for x in words]
        gold[r, : len(words)] = own
        real[r, : len(words)] = True
    target = np.eye(k)[gold] * real[:, :, None]
    true_moves = np.zeros((k, k))
    both = real[:, 1:]
    np.add.at(true_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    squares = np.full((SIZE, k), 1e-8)
    before = -np.inf
    for _ in range(rounds):
        scores = np.add.reduceat(model.weights[ids], first, axis=0) / np.sqrt(n)[:, None]
        post, moves, begin, _ = model.forward_backward(scores[index], real)
        now = np.log(np.maximum((post * target).sum(axis=2)[real], 1e-12)).mean()
        if now - before < least:
            break
        before = now
        miss = (target - post) * real[:, :, None]
        by_word = np.stack([np.bincount(index[real], miss[real][:, c], len(n)) for c in range(k)], axis=1)
        step = np.stack([np.bincount(ids, by_word[owner, c] * scale, SIZE) for c in range(k)], axis=1) - 1e-3 * model.weights
        squares += step**2
        model.weights += 0.5 * step / np.sqrt(squares)
        model.moves += 0.5 * (true_moves - moves) / max(1.0, true_moves.sum())
        model.begin += 0.2 * (np.bincount(gold[:, 0], minlength=k) - begin) / len(rows)
    model.moves = np.maximum(model.moves, model.moves.max() - 7)
    return model


_memory: dict = {}


def scores_of(model: Chain, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores and letters of each distinct word of a batch, and each word's place among them."""
    distinct, first, place = np.unique(h, return_index=True, return_inverse=True)
    raw = w.buffer.tobytes()
    words = [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
    letters = np.array([has_letter(x) for x in words], np.float64)
    return np.column_stack([model.emissions(words), letters]), place


def classify(model: Chain, rows: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the language's share of the posterior, weighted by letters."""
    k = len(model.langs)
    w = split(rows)
    if not len(w.start) or not k:
        return [UNKNOWN] * len(rows), [0.0] * len(rows)
    table, place = scores_of(model, w, hashes(w))
    run, at, row = runs_of(w)
    real = np.zeros((len(row), CHAIN), bool)
    real[run, at] = True
    scores = np.zeros((len(row), CHAIN, k))
    scores[run, at] = table[place, :k]
    post = model.forward_backward(scores, real)[0]
    letters = table[place, k]
    share = np.stack([np.bincount(w.doc, post[run, at, c] * letters, len(rows)) for c in range(k)], axis=1)
    total = np.bincount(w.doc, letters, len(rows))
    best = share.argmax(axis=1)
    value = np.clip(np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0), 0, 1)
    return [model.langs[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)], value.tolist()


def label_words(model: Chain, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its likeliest language; words without letters are unknown."""
    w = split([text.encode()])
    if not len(w.start):
        return []
    table, place = scores_of(model, w, hashes(w))
    run, at, row = runs_of(w)
    real = np.zeros((len(row), CHAIN), bool)
    real[run, at] = True
    scores = np.zeros((len(row), CHAIN, len(model.langs)))
    scores[run, at] = table[place, : len(model.langs)]
    best = model.forward_backward(scores, real)[0][run, at].argmax(axis=1)
    raw = w.buffer.tobytes()
    return [(raw[a:b].decode(), model.langs[c] if n else UNKNOWN) for a, b, c, n in zip(w.start, w.end, best, table[place, -1], strict=True)]


def samples(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[bytes]]:
    """By language, a run of SAMPLE_WORDS words of up to SAMPLE_DOCS documents of least id hash outside the held-out fold.

    The documents are chosen by id and language alone, in a first reading that doesn't touch texts: ids whose hash lies
    below a threshold set from the language's size, of these the first SAMPLE_DOCS. The MOST_LANGS languages with most
    rows are learned. An id counts once in each language, with the least of its rows' runs of words, so repeated rows
    don't make the sample larger.
    """
    from pyspark.sql import Window

    known = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("key").isNotNull() & ~held_out("key", 5, 0))
    hashed = known.withColumn("h", F.xxhash64(F.col("key").cast("string")))
    share = F.least(F.lit(1.0), (2.0 * SAMPLE_DOCS + 20) / F.col("n"))  # about twice the documents wanted
    cuts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).select("lang", share.alias("share"))
    near = hashed.join(F.broadcast(cuts), "lang").filter(hash_share("h") < F.col("share")).select("lang", "key", "h").distinct()
    chosen = near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("i") <= SAMPLE_DOCS).select("lang", "key")
    given = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), ["lang", "key"])  # MOST_LANGS * SAMPLE_DOCS keys
    words = F.split("text", "[\\x20\\x09-\\x0D]+")
    start = F.pmod(F.xxhash64("key", F.lit("start")), F.greatest(F.size(words) - SAMPLE_WORDS, F.lit(1))).cast("int") + 1
    runs = given.select("lang", "key", F.array_join(F.slice(words, start, SAMPLE_WORDS), " ").alias("t"))
    out: dict[str, list[bytes]] = {}
    for r in sorted(runs.groupBy("lang", "key").agg(F.min("t").alias("t")).collect(), key=lambda r: (r["lang"], r["t"])):
        out.setdefault(r["lang"], []).append(r["t"].encode())
    return out


def languages(docs: DataFrame, model: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, lang_pred and score (0 to 1).

    Null texts and those without letters are `und` with score 0, and so is every text if nothing could be learned.
    Ties go to the first language by name. Repeated rows are labelled alike. Source, lang and other columns are never
    read here, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", 1 << 20):
            langs, score = classify(sent.value, texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    got = map_rows(docs.select(F.col(key), F.col(text).alias("text")), run, f"`{key}` {own}, lang_pred string, score double")
    return got.select(key, held_out(key, 5, 0).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all whole documents, learned from a bounded sample outside the held-out fifth."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return languages(docs, fit(samples(docs)))
