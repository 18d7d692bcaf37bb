"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans they miss.

Around every chunk of text with a digit or an at sign (an island) the field chooses segments: single tokens outside, or
entities of up to MOST tokens. A candidate segment is scored by features of the whole span (its shape, its digits, its
checksum, what stands beside it); dynamic programming picks boundaries and kinds together. It is trained on spans that
patterns find in a bounded sample of documents, some of them rewritten the way people disguise or shorten such data.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MOST = 12
#: Documents drawn for training, islands taken from each, islands trained on, and characters that one of them has, at most.
SAMPLE_DOCS, A_DOCUMENT, SAMPLE_ISLANDS, LONGEST = 30_000, 4, 900, 400

# --- fixed patterns -----------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, walking left from each at sign: linear in the text, however long its runs of letters are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in BASE, end) of the fixed patterns, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := DIGITS.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.sub("", m.group())) <= 15]
    return sorted(out)


#: Patterns of keys and credentials, used only to label training spans.
SECRET = re.compile(r"AKIA[0-9A-Z]{16}|password ?[=:] ?\S+|(?:token|secret|api_key) ?[=:] ?\"?[0-9A-Za-z]{12,}\"?")

# --- islands ------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"\w+|\s|[^\w\s]")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around chunks with a digit or an at sign, with two chunks on either side; they don't overlap."""
    start = end = -1
    at = 0
    while m := TRIGGER.search(text, at):
        a, b = m.start(), m.end()
        for _ in range(3):
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            a = max(0, a - 1)
        for _ in range(3):
            while b < len(text) and not text[b].isspace():
                b += 1
            b = min(len(text), b + 1)
        if end >= a:
            end = b
        else:
            if end >= 0:
                yield start, end
            start, end = a, b
        at = max(m.end(), b)
        # the next trigger may lie in what was just taken: b is past the right context, whose own triggers extend it
        inner = TRIGGER.search(text, m.end(), b)
        if inner:
            at = inner.start()
            while at < b and not text[at].isspace():
                at += 1
    if end >= 0:
        yield start, end


def shape(token: str) -> str:
    """A token's class and length: digits by number, letters, hexadecimal or mixed strings by size; others as they are."""
    if token.isspace():
        return "_"
    if token.isdigit():
        return f"d{min(len(token), 20)}"
    if token.isalpha():
        return ("A" if token.isupper() else "a") + ("" if len(token) < 16 else "+")
    if len(token) == 1:
        return token
    kind = "h" if all(c in "0123456789abcdefABCDEF" for c in token) else "M" if token.upper() == token else "m"
    return kind + ("1" if len(token) < 8 else "2" if len(token) < 14 else "3")


KEYWORDS = frozenset(("password", "token", "secret", "api_key", "passwd", "key"))
SIZE = 1 << 13


def _id(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


@dataclass
class Field:
    """Weights of span features by kind, and of an entity's beginning after a token outside or after an entity."""

    weights: np.ndarray
    after: np.ndarray
    known: dict = field(default_factory=dict)

    def segments(self, text: str) -> tuple[list[re.Match], list[tuple[int, int, list[int]]]]:
        """Tokens, and candidate entities (first token, end token, feature ids)."""
        tokens = list(TOKEN.finditer(text))
        shapes = [shape(t.group()) for t in tokens]
        out = []
        n = len(tokens)
        useful = [s[0] in "dhmM@" or t.group().isupper() for s, t in zip(shapes, tokens, strict=True)]
        for i in range(n):
            if shapes[i] == "_":
                continue
            some = False
            for j in range(i + 1, min(n, i + MOST) + 1):
                some |= useful[j - 1]
                if shapes[j - 1] == "_":
                    if "\n" in tokens[j - 1].group():
                        break
                    continue
                if some:
                    out.append((i, j, self.features(text, tokens, shapes, i, j)))
        return tokens, out

    def features(self, text: str, tokens: list, shapes: list[str], i: int, j: int) -> list[int]:
        span = text[tokens[i].start() : tokens[j - 1].end()]
        digits = DIGITS.sub("", span)
        before = shapes[i - 1] if i else "^"
        word = tokens[i].group().lower() if tokens[i].group().lower() in KEYWORDS else ""
        check = luhn(digits) if 14 <= len(digits) <= 19 else False
        octets = span.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in span.split("."))
        # all that the names below are made of: what was read before mustn't matter
        key = (tuple(shapes[i:j]), before, shapes[j] if j < len(tokens) else "$", word, check, octets, len(digits))
        got = self.known.get(key)
        if got is None:
            whole = "".join(shapes[i:j])
            kinds = "".join(s[0] for s in shapes[i:j])
            names = ["bias", f"n{j - i}", f"whole {whole}", f"kinds {kinds}", f"first {shapes[i]}", f"last {shapes[j - 1]}", f"digits {len(digits)}", f"before {before[0]}", f"next {key[2][0]}", f"word {word}", f"check {check}", f"octets {octets}", f"at {'@' in kinds} {kinds.count('.')}", f"ends {shapes[i][0]} {shapes[j - 1][0]} {len(digits) > 9}"]
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = [_id(x) for x in names]
        return got

    def scores(self, segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
        return self.weights[np.array([s[2] for s in segments], np.int64)].sum(axis=1) if segments else np.zeros((0, len(KINDS)))

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation."""
        tokens, segments = self.segments(text)
        if not segments:
            return []
        scores = self.scores(segments)
        n = len(tokens)
        into: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j, _) in enumerate(segments):
            into[j].append(s)
        best = [[0.0, -math.inf]] + [[-math.inf, -math.inf] for _ in range(n)]  # last token outside, or last an entity
        back: list[list] = [[None, None] for _ in range(n + 1)]
        top = [(scores + self.after[c]) for c in (0, 1)]
        kind = [t.argmax(axis=1) for t in top]
        value = [t.max(axis=1).tolist() for t in top]
        for t in range(1, n + 1):
            c = 0 if best[t - 1][0] >= best[t - 1][1] else 1
            best[t][0], back[t][0] = best[t - 1][c], (t - 1, c, None)
            for s in into[t]:
                i = segments[s][0]
                for c in (0, 1):
                    v = best[i][c] + value[c][s]
                    if v > best[t][1]:
                        best[t][1], back[t][1] = v, (i, c, int(kind[c][s]))
        out = []
        t, c = n, 0 if best[n][0] >= best[n][1] else 1
        while t > 0:
            i, before, k = back[t][c]
            if k is not None:
                out.append((tokens[i].start(), k, tokens[t - 1].end()))
            t, c = i, before
        return out[::-1]

    def learn(self, text: str, gold: list[tuple[int, int, int]], rate: float, squares: np.ndarray) -> None:
        """One step of gradient ascent on the log likelihood of a segmentation, by forward-backward over segments."""
        tokens, segments = self.segments(text)
        starts = {t.start(): i for i, t in enumerate(tokens)}
        ends = {t.end(): i + 1 for i, t in enumerate(tokens)}
        right = {(starts[a], ends[b]): k for a, k, b in gold if a in starts and b in ends}
        if not segments or len(right) != len(gold) or any(p not in {s[:2] for s in segments} for p in right):
            return
        scores = self.scores(segments)
        n = len(tokens)
        into: list[list[int]] = [[] for _ in range(n + 1)]
        out_of: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, j, _) in enumerate(segments):
            into[j].append(s)
            out_of[i].append(s)
        local = np.stack([np.logaddexp.reduce(scores + self.after[c], axis=1) for c in (0, 1)]).tolist()
        f = [[0.0, -math.inf]] + [[-math.inf] * 2 for _ in range(n)]
        b = [[-math.inf] * 2 for _ in range(n)] + [[0.0, 0.0]]
        for t in range(1, n + 1):
            f[t][0] = np.logaddexp(*f[t - 1])
            terms = [f[segments[s][0]][c] + local[c][s] for s in into[t] for c in (0, 1)]
            f[t][1] = float(np.logaddexp.reduce(terms)) if terms else -math.inf
        for t in range(n - 1, -1, -1):
            for c in (0, 1):
                terms = [b[t + 1][0], *(local[c][s] + b[segments[s][1]][1] for s in out_of[t])]
                b[t][c] = float(np.logaddexp.reduce(terms))
        total = np.logaddexp(*f[n])
        grad = np.zeros_like(scores)
        after = np.zeros_like(self.after)
        previous = 0
        for s, (i, j, _) in enumerate(segments):
            for c in (0, 1):
                if f[i][c] > -math.inf:
                    p = np.exp(scores[s] + self.after[c] + f[i][c] + b[j][1] - total)
                    grad[s] -= p
                    after[c] -= p
        for s, (i, j, _) in enumerate(segments):
            if (k := right.get((i, j))) is not None:
                grad[s, k] += 1
        spans = sorted(right)
        for (i, j), last in zip(spans, [None, *spans], strict=False):
            previous = int(last is not None and last[1] == i)
            after[previous, right[i, j]] += 1
        busy = np.flatnonzero(np.abs(grad).max(axis=1) > 1e-4)
        if len(busy):
            ids = np.array([segments[s][2] for s in busy])
            flat, rows = ids.ravel(), np.repeat(grad[busy], ids.shape[1], axis=0)
            step = np.zeros_like(self.weights)
            np.add.at(step, flat, rows)
            used = np.unique(flat)
            squares[used] += step[used] ** 2
            self.weights[used] += rate * step[used] / np.sqrt(squares[used] + 1e-6)
            self.after += 0.02 * np.clip(after, -1, 1)


# --- training -----------------------------------------------------------------------------------------------------


def rewritten(text: str, gold: list[tuple[int, int, int]], chance: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The island with some of its spans in other forms: phones without a plus sign, other separators, grouped cards."""
    out, spans, at = "", [], 0
    for a, k, b in gold:
        out += text[at:a]
        span = text[a:b]
        if KINDS[k] == "phone" and chance.random() < 0.6:
            d = DIGITS.sub("", span)
            d = d[-10:] if len(d) >= 10 else d
            x, y, z = d[:3], d[3:6], d[6:]
            span = chance.choice([f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"{x} {y} {z}", f"1-{x}-{y}-{z}", f"+1 {x} {y} {z}"])
        elif KINDS[k] == "card" and chance.random() < 0.4:
            d = DIGITS.sub("", span)
            s = chance.choice([" ", "-", "."])
            span = s.join(d[i : i + 4] for i in range(0, len(d), 4))
        spans.append((len(out), k, len(out) + len(span)))
        out += span
        at = b
    return out + text[at:], spans


def labelled(text: str) -> list[tuple[int, int, int]]:
    """Spans by the fixed patterns and those of secrets; of overlapping ones the first, then the longest stays."""
    spans = base_spans(text) + [(m.start(), KINDS.index("secret"), m.end()) for m in SECRET.finditer(text)]
    out: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[2])):
        if not out or s[0] >= out[-1][2]:
            out.append(s)
    return out


Island = tuple[str, list[tuple[int, int, int]]]


def gold_islands(text: str, most: int | None = None) -> list[Island]:
    """Islands of a text of under LONGEST characters with their labelled spans; those of least hash if there are more than `most`."""
    spans = labelled(text)
    out = []
    for a, b in islands(text):
        if b - a < LONGEST:
            out.append((text[a:b], [(s - a, k, e - a) for s, k, e in spans if s >= a and e <= b]))
    return out if most is None or len(out) <= most else sorted(out, key=lambda x: zlib.crc32(x[0].encode()))[:most]


def train(given: list[Island], most: int = SAMPLE_ISLANDS, rounds: int = 3) -> Field:
    """A field fitted to labelled islands, the first ones of each kind up to an equal share of `most`."""
    chance = random.Random(11)
    model = Field(np.zeros((SIZE, len(KINDS))), np.zeros((2, len(KINDS))))
    model.weights[_id("bias")] = -1.0
    rows, left = [], {k: most // 4 for k in range(-1, len(KINDS))}
    for text, gold in given:
        kind = gold[0][1] if gold else -1
        if left[kind] > 0 and len(rows) < most:
            left[kind] -= 1
            rows.append(rewritten(text, gold, chance))
    squares = np.zeros_like(model.weights)
    for turn in range(rounds):
        chance.shuffle(rows)
        for text, gold in rows:
            model.learn(text, gold, 0.3 / (1 + turn), squares)
    return Field(model.weights, model.after)


def sample_islands(docs: DataFrame, most: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text") -> list[Island]:
    """Labelled islands of about `most` documents of least hash of key and text, up to A_DOCUMENT of each; only islands go to the driver."""
    given = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    chosen = drawn(given, most, F.col("k"), F.col("text"), n=docs.count()).filter(F.col("text").rlike("[0-9@]")).select("h", "text")
    names = ["h", "n", "island", "gold"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(h, n, *x) for h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, x in enumerate(gold_islands(t, A_DOCUMENT))]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())]
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [[v for span in r[3] for v in span] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    rows = map_rows(chosen, run, "h long, n int, island string, gold array<int>").collect()
    return [(r["island"], list(zip(*[iter(r["gold"])] * 3, strict=True))) for r in sorted(rows, key=lambda r: (r["h"], r["n"]))]


# --- the operator -------------------------------------------------------------------------------------------------


def find_spans(text: str | None, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed patterns' spans and the field's that overlap none of them; sorted (start, kind, end)."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added = []
    for a, b in islands(text):
        for s, k, e in model.decode(text[a:b]):
            if not any(s + a < y and x < e + a for x, _, y in base):
                added.append((s + a, k, e + a))
    return base, added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone and base_sha256 of the fixed patterns, spans with the field's, n_added.

    Null and empty texts have no spans. Repeated rows get the same spans. Ends are exclusive, in code points. Other
    columns are not read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    own = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in names[1:]]
        for t in batch.column("text").to_pylist():
            base, added = find_spans(t, sent.value)
            row = [sum(k == i for _, k, _ in base) for i in range(4)]
            row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)]
            for to, x in zip(columns, row, strict=True):
                to.append(x)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    given = docs.select(F.col(key), F.col(text).alias("text"))
    return map_rows(given, run, f"`{key}` {own}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all whole documents, with a field trained on a bounded sample of them."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(sample_islands(docs)))
