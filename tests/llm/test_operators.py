"""The ten operators and the pipeline against definitions, round trips and held-out labels, with odd rows everywhere."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brocade.llm import common, decontaminate, embeddings, language, mixing, passages, pii, quality, simhash, tokens, toxicity
from brocade.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, spans string, vec binary"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns with the names that operators use inside."""
    long = " ".join(f"w{i % 977} +1 (416) 555-2113" if i % 501 == 0 else f"w{i % 977}x{i % 13}" for i in range(60_000))
    words = " ".join(f"same{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, words), (5, words), (5, words), (6, f"x {words} y"), (7, long), (8, "a"), (9, "!!! 123"), (10, long)]
    return spark.createDataFrame([(i, t, None, None, 0, "s", None) for i, t in rows], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_base_patterns(texts):
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 14 <= len(d) <= 19 and pii.luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return sorted(out)

    tricky = ["a@b.c@d.e x@y @z.q ..@a.b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4111 1111 1111 1111-2 4111-1111-1111-1111", "+1 (416) 555-2113 +1 +1-- ++12345678901", "é+a@b-.-c.d,", "9" * 3000, "a." * 3000 + "@", "1." * 2001]
    for t in [*tricky, *texts.values()]:
        assert pii.base_spans(t) == plain(t)


def test_pii_adds_spans(texts):
    model = pii.train([x for t in sorted(texts.values()) if pii.TRIGGER.search(t) for x in pii.gold_islands(t)], most=300)
    base, added = pii.find_spans("write to a.b@c.de or 555-123-4567 now", model)
    assert [k for _, k, _ in base] == [0]
    right = whole = 0
    for t in texts.values():
        gold = set(pii.labelled(t))
        found = {(a + s, k, a + e) for a, b in pii.islands(t) for s, k, e in model.decode(t[a:b])}
        whole += len(gold)
        right += len(gold & found)
    assert right >= 0.9 * whole
    assert all(not any(a < y and x < b for x, _, y in base) for a, _, b in added)


def segmentations(tokens, segments, at=0):
    """All ways to cover the tokens from `at` on: (segment or None for a token outside) lists."""
    if at == tokens:
        yield []
        return
    for rest in segmentations(tokens, segments, at + 1):
        yield [None, *rest]
    for s, (i, j, _) in enumerate(segments):
        if i == at:
            for rest in segmentations(tokens, segments, j):
                yield [s, *rest]


def test_field_against_all_segmentations():
    rng = np.random.default_rng(9)
    kinds = len(pii.KINDS)
    for text in ("a1 22", "x@y 7", "(41) 5", "k=9a b"):
        model = pii.Field(rng.normal(scale=2, size=(pii.SIZE, kinds)), rng.normal(size=(2, kinds)))
        tokens, segments = model.segments(text)
        scores = model.scores(segments)

        def paths():
            for path in segmentations(len(tokens), segments):
                own = [s for s in path if s is not None]
                for labels in np.ndindex(*(kinds,) * len(own)) if len(own) < 4 else ():
                    z, last, k = 0.0, 0, iter(labels)
                    out = []
                    for s in path:
                        if s is None:
                            last = 0
                        else:
                            c = next(k)
                            z += scores[s, c] + model.after[last, c]
                            out.append((tokens[segments[s][0]].start(), c, tokens[segments[s][1] - 1].end()))
                            last = 1
                    yield z, out

        every = list(paths())
        best = max(every, key=lambda x: x[0])
        got = model.decode(text)
        assert len(got) > 3 or got == best[1]
        gold = next(o for _, o in every if len(o) == 1)
        likelihood = lambda: (lambda e: next(z for z, o in e if o == gold) - np.logaddexp.reduce([z for z, _ in e]))(list(paths()))  # noqa: B023, E731
        before = likelihood()
        model.learn(text, gold, 0.01, np.zeros_like(model.weights))
        scores = model.scores(segments)
        assert likelihood() > before


def test_pii_other_forms(spark):
    """Forms that the patterns miss, none of them in the training texts: what the field finds of each kind."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(pii.sample_islands(docs))
    tries = {"phone": ["call (416) 555-2113 now", "call 555-123-4567 now", "call 416.555.2113 now", "at 1-905-555-0147 please"], "secret": ["the password: hunter2x9 is old", "set api_key=Zk39fj20dkA1 there"]}
    found = {k: [any(pii.KINDS[x] == k for _, x, _ in pii.find_spans(t, model)[1]) for t in ts] for k, ts in tries.items()}
    print("forms beyond the patterns:", found)
    assert sum(found["phone"]) >= 3
    assert len(pii.sample_islands(docs, 500)) < 500 * pii.A_DOCUMENT


def test_pii_reading_order(texts):
    """What a worker has read before doesn't change what it finds: mixed tokens of one shape have different numbers of digits."""
    rng = np.random.default_rng(4)
    weights, after = rng.normal(size=(pii.SIZE, len(pii.KINDS))), rng.normal(size=(2, len(pii.KINDS)))
    tries = ["key a1b2 x", "key a123 x", "key ab12 x", "key 1234 x", "a1b2-c3 9", "a123-cc 9", *[t[:200] for t in list(texts.values())[:40]]]
    ids = lambda model, t: [s for s in model.segments(t)[1]]
    forwards, backwards = pii.Field(weights, after), pii.Field(weights, after)
    one = [ids(forwards, t) for t in tries]
    two = [ids(backwards, t) for t in reversed(tries)][::-1]
    assert one == two and one == [ids(pii.Field(weights, after), t) for t in tries]


def test_pii_odd_rows(odd, none):
    model = pii.train([])
    got = {r["doc_id"]: r for r in pii.personal_data(odd, model).collect()}
    assert len(got) == 10 and got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["n_phone"] == 120 and pii.personal_data(none, model).count() == 0


def test_pii_odd_digits():
    model = pii.train([])
    many = "0" * 5000 + "1.2.3.4"
    for t in ("see 1.2.3.4² or ①.2.3.4 there", many, "1.2.3.4²"):
        base, _ = pii.find_spans(t, model)
        assert base == pii.base_spans(t) and base
        assert isinstance(model.decode(t), list) and isinstance(model.decode("v 1.2.3.²4"), list)


def test_repeats(spark, docs, odd, none):
    mixed = docs.select("doc_id", "text").union(odd.filter("doc_id <> 5").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    want = passages.brute_force([(r["doc_id"], r["text"]) for r in mixed.collect()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in passages.remove_repeats(mixed).collect()}
    assert got == want and sum(x[1] for x in got.values()) > 0
    assert passages.remove_repeats(none).count() == 0
    again = Counter((r["doc_id"], r["n_removed"]) for r in passages.remove_repeats(odd).collect())
    assert again[5, 40] == 2 and again[6, 40] == 1 and again[10, 60_000 + 3 * 120] == 1
    keyless = passages.remove_repeats(spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["kept"]) for r in keyless} == {(None, "a b"), (1, "")}


def covered(df):
    return {(r["doc"], k) for r in df.collect() for s in r["spans"] for k in range(s["start"], s["stop"])}


def test_repeats_small_bitmap_and_common_phrases(spark, docs, monkeypatch):
    # a bitmap far too small, and shards so small that many minimizers are spread by window: equal ranges, two readings
    line = " ".join(f"common{i}" for i in range(9))
    rows = [(10_000 + i, f"a{i} b{i} c{i} d{i} e{i} {line} f{i} g{i} h{i} i{i} {line} {line}") for i in range(600)]
    given = docs.select(F.col("doc_id").alias("doc"), "text").union(spark.createDataFrame(rows, "doc long, text string")).withColumn("same", F.xxhash64("text"))
    readings, one = [], passages.map_rows
    monkeypatch.setattr(passages, "map_rows", lambda df, fn, schema: readings.append(schema) or one(df, fn, schema))
    want = covered(passages.repeated_ranges(given))
    assert len(readings) == 2 and want
    spread, split = [], passages.spread
    monkeypatch.setattr(passages, "spread", lambda *a: spread.append(a) or split(*a))
    for bits, a_shard in ((1 << 15, 16_384), (1 << 20, 16), (1 << 15, 16)):
        readings.clear()
        assert covered(passages.repeated_ranges(given, bits=bits, a_shard=a_shard)) == want
        assert len(readings) == 2
    seed, key, first, last = split(np.arange(40, dtype=np.uint64), np.array([5, 6], np.uint64), np.array([0, 9]), np.array([3, 12]), np.array([True, False]), 13)
    assert first.tolist() == [0, 1, 2, 3, 9] and last.tolist() == [0, 1, 2, 3, 12] and len(set(key.tolist())) == 5 and key[-1] == 6


def test_repeated_rows_of_one_text(spark):
    words = " ".join(f"same{i}" for i in range(60))
    rows = spark.createDataFrame([(1, words)] + [(2, words)] * 300, "doc long, text string").withColumn("same", F.xxhash64("text"))
    got = passages.repeated_ranges(rows).collect()
    assert len(got) == 1 and got[0]["doc"] == 2 and len(got[0]["spans"]) < 60


def components_of(fps, most):
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= most:
                up[find(x)] = find(y)
    return {x: find(x) for x in fps}


def test_simhash(spark, docs, odd, none):
    import xxhash

    near = docs.select("doc_id", "text").union(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_groups(near).collect()]
    roots = components_of(sorted({f for _, f, _ in got}), 2)
    least = {}
    for i, f, _ in got:
        least[roots[f]] = min(least.get(roots[f], i), i)
    assert len(got) == docs.count() + 11 and all(c == least[roots[f]] for _, f, c in got)
    text = "One two three Four"
    h = [xxhash.xxh64_intdigest(s, 42) for s in ("one two three", "two three four")]
    assert simhash.fingerprint(text.encode()) == h[0] & h[1] and simhash.fingerprint(b"") == 0
    assert simhash.simhash_groups(none).count() == 0


def test_full_anchors_are_split(spark):
    # many fingerprints about few anchors, so that each is dealt over many parts; links stay the same
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 4)
    x = np.unique(np.concatenate([b ^ rng.integers(0, 1 << 12, 150) << np.int64(48) for b in base] + [rng.integers(0, 2**62, 100)]))
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    whole, parts = ({r["node"]: r["root"] for r in simhash.link_fingerprints(df, homes=h).collect()} for h in (20_000, 3))
    want = components_of([int(v) for v in x], 2)
    for got in (whole, parts):
        assert all((got.get(a, a) == got.get(b, b)) == (want[a] == want[b]) for a in map(int, x[:120]) for b in map(int, x))


def test_anchors_cover():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 300, dtype=np.int64)
    flips = rng.integers(0, 64, (300, 2))
    y = x ^ np.bitwise_xor.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64)), axis=1).view(np.int64)
    row, code, home = simhash.anchors(x.view(np.uint64), 2)
    assert (np.bincount(row[home]) == 1).all()
    of = dict(zip(row[home].tolist(), code[home].tolist()))
    there = set(zip(*(a.tolist() for a in simhash.anchors(y.view(np.uint64), 2)[:2])))
    assert all((i, of[i]) in there for i in range(300))


def test_near_copies(spark, docs, odd, none):
    # a text of one word over and over has few shingles, whose majority a single change can turn
    base = [r["text"] for r in docs.filter("length(text) > 1500").orderBy("doc_id").collect() if len({*r["text"].split()}) > 0.3 * len(r["text"].split())][:20]
    changed = []
    for t in base:
        w = t.split()
        w[len(w) // 2] = "changed"
        changed.append(" ".join(w))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(base + changed + base)], "doc_id long, text string").withColumn("node", F.lit(0))
    kept = {r["doc_id"] for r in simhash.keep_one(rows).collect()}
    assert len(kept) <= 21 and max(kept) < 21
    one = simhash.keep_one(odd)
    assert one.columns == odd.columns and {r["doc_id"] for r in one.collect()} >= {1, 4, 7, 8, 9} and one.filter("doc_id = 5 or doc_id = 10").count() == 0
    assert simhash.keep_one(none).count() == 0
    assert simhash.bits_apart(1.0) == 0 and 18 <= simhash.bits_apart(0.8) <= 21


def five(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups_of(rows, at=0.8):
    """Components of pairs with that similarity of five-word shingles, each as the set of its places."""
    sets = [five(t) for t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) / len(x | y) >= at:
                up[find(i)] = find(j)
    return {frozenset(j for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def found_groups(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    of = {r["node"]: r["root"] for r in simhash.near_copies(df).collect()}
    node = {r["doc_id"]: r["n"] for r in df.select("doc_id", F.xxhash64("text").alias("n")).collect()}
    return {frozenset(j for j in node if of.get(node[j], node[j]) == of.get(node[i], node[i])) for i in node}


def test_near_copies_exact(spark):
    # scattered edits, with similarities from 0.7 to 0.9: links are those of the exact similarity, not of an estimate
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(150):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        v = list(w)
        for k in rng.choice(300, int(rng.integers(3, 12)), replace=False):
            v[k] = "new"
        rows += [" ".join(w), " ".join(v)]
    near = [len(five(a) & five(b)) / len(five(a) | five(b)) for a, b in zip(rows[::2], rows[1::2])]
    assert sum(0.7 <= x < 0.8 for x in near) > 20 and sum(0.8 <= x < 0.9 for x in near) > 20
    assert found_groups(spark, rows) == groups_of(rows)


def test_near_copies_blocks(spark):
    # one paragraph replaced or dropped
    rng = np.random.default_rng(12)
    rows = []
    for n in range(200):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        k, at = int(rng.integers(24, 30)) if n % 2 else int(rng.integers(48, 58)), int(rng.integers(20, 200))
        rows += [" ".join(w), " ".join(w[:at] + [f"v{x}" for x in rng.integers(0, 10**6, k if n % 2 else 0)] + w[at + k :])]
    want = groups_of(rows)
    assert sum(len(g) == 2 for g in want) > 100 and found_groups(spark, rows) == want


def test_near_copies_repeats(spark):
    # distinct texts with one line many times, and near copies of texts that repeat themselves
    rng = np.random.default_rng(13)
    line = " ".join(f"line{i}" for i in range(10))
    rows = []
    for _ in range(40):
        own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 150)) for _ in range(2)]
        rows.append(own[0] + f" {line}" * 30 + " " + own[1])
    for i in range(20):
        w = [f"r{i}x{x}" for x in range(100)]
        rows += [" ".join(w + w[:10] * 20), " ".join(w + w[:10] * 3)]
    want = groups_of(rows)
    assert sum(len(g) == 2 for g in want) == 20 and found_groups(spark, rows) == want
    node = spark.createDataFrame([(t,) for t in rows[:2]], "text string").withColumns({c: F.lit(0).cast("long") for c in ("node", "other")}).toArrow().to_batches()
    sketch = [r for b in node for part in simhash.sketches(5)(b) for r in part.to_pylist()]
    assert sum(((sketch[0][v] ^ sketch[1][v]) & (2**64 - 1)).bit_count() for v in ("v0", "v1")) > simhash.loose_bits(0.8)


@pytest.mark.parametrize("weight", [1 << 19, 4000])
def test_near_copies_crowd(spark, monkeypatch, weight):
    monkeypatch.setattr(simhash, "WEIGHT", weight)  # with the small one finer keys come in, and the heaviest are dealt over parts
    # one text edited in many ways: a crowd about half alike, in which only few pairs are near; small batches cut keys
    rng = np.random.default_rng(14)
    base = [f"b{x}" for x in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            w[k] = f"e{rng.integers(0, 3)}"
        rows.append(" ".join(w))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = found_groups(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = groups_of(rows)
    assert got == want and 1 < len(want) < 250


def test_near_copies_meet_at_anchors(spark):
    # candidates come from anchors: code words within 3 of each block of a SimHash, shared by the texts that meet
    rng = np.random.default_rng(15)
    rows = []
    for _ in range(60):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        v = list(w)
        for k in rng.choice(200, int(rng.integers(1, 9)), replace=False):
            v[k] = "new"
        rows += [" ".join(w), " ".join(v)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "node long, other long, text string")
    made = df.mapInArrow(lambda b: (x for y in b for x in simhash.sketches(5)(y)), "node long, other long, size long, v0 long, v1 long, anchors binary")
    at = {r["node"]: np.frombuffer(bytes(r["anchors"]), np.int32) for r in made.collect()}
    part = spark.createDataFrame([(0, 0, rows[0])], "node long, other long, text string").toArrow().to_batches()[0]
    bits = simhash.sketch(*simhash._shingle_sets(part, 5))[0]
    whole = sum(int(x) << (64 * k) for k, x in enumerate(bits))
    for t in range(simhash.BLOCKS):
        block, code = (whole >> (23 * t)) & (2**23 - 1), int(at[0][t])
        assert code >> 23 == t and (block ^ code & (2**23 - 1)).bit_count() <= 3
        assert simhash.syndromes(np.array([code & (2**23 - 1)]))[0] == 0
    led = simhash._led(made, 0.8, 4).collect()
    met = {frozenset((r["node"], r["leader"])) for r in led if r["near"]}
    assert all((at[a] == at[b]).any() for a, b in met)
    near = {frozenset((i, i + 1)) for i in range(0, 120, 2) if len(five(rows[i]) & five(rows[i + 1])) >= 0.8 * len(five(rows[i]) | five(rows[i + 1]))}
    assert len(near) > 20 and near <= met


@pytest.mark.parametrize("words,edits", [(49, 1), (8, 0)])
def test_near_copies_miss_few(spark, words, edits):
    # pairs at just 0.8, of 45 shingles each and of the smallest sets there are (4 of 5 shingles)
    rng = np.random.default_rng(16)
    rows = []
    for _ in range(2000):
        w = [f"w{x}" for x in rng.integers(0, 10**7, words)]
        v = [*w[: words // 2], "new", *w[words // 2 + 1 :]] if edits else [*w, "new"]
        rows += [" ".join(w), " ".join(v)]
    near = sum(len(five(a) & five(b)) / len(five(a) | five(b)) == 0.8 for a, b in zip(rows[::2], rows[1::2]))
    found = sum(len(g) == 2 for g in found_groups(spark, rows))
    print("pairs", near, "found", found)
    assert near == 2000 and found >= 0.995 * near


def test_near_copies_full_anchors(spark, monkeypatch):
    # anchors with many entries are dealt over parts of which each two meet; the groups stay the same
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(40):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        rows += [" ".join([*w[:k], "new", *w[k + 1 :]]) for k in (3, 40, 70)]
    base = [f"b{x}" for x in range(200)]
    rows += [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 200, 2)]
    want = found_groups(spark, rows)
    monkeypatch.setattr(simhash, "MOST_HELD", 10)
    assert found_groups(spark, rows) == want == groups_of(rows)


def test_near_copies_equal_hashes(spark, monkeypatch):
    # unequal texts with equal first hashes: none is lost as a copy of the other
    monkeypatch.setattr(simhash, "text_hash", lambda text: F.length(text).cast("long"))
    rows = [(1, "some words here"), (2, "words here some"), (3, "some words here"), (4, "other"), (5, "rehto"), (6, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("own", "other", "nth", "node")})
    got = simhash.keep_one(df)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == {1, 2, 4, 5}


def test_near_copies_recall(spark):
    """Recall of pairs at 0.8 or more of the given documents against all pairs."""
    rows = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    want, got = groups_of(rows), found_groups(spark, rows)
    print("near-copy groups", sum(len(g) > 1 for g in want), "equal:", len(want & got) / len(want))
    assert got == want


def test_embeddings(spark, none):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    x = np.vstack([c + rng.normal(scale=0.07, size=(12, 16)) for c in centre] + [np.repeat(centre[:2], 30, axis=0)])
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [None] * 16), (9006, [1.0] * 3), (5, rows[5][1])]
    rows += [(9011, [1.0, 0.0]), (9012, [1.0, 0.001]), (9013, [0.0, 1.0]), (9014, [1.0, 0.0, 0.0])]  # other lengths link among themselves
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("vec", "id", "list", "rep", "h", "bytes")})
    u = np.array([v for i, v in rows[: len(x)]] + [rows[5][1]])  # the vectors of the most frequent length
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = embeddings.embedding_groups(df).collect()
    by = {r["vec_id"]: r for r in got if r["vec_id"] != 5}
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got) >= 0.9 * links.sum() and all(by[i]["n_links"] <= links[i] for i in range(len(x)) if i != 5)
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (*range(9001, 9007), 9013, 9014))
    assert by[9011]["n_links"] == by[9012]["n_links"] == 1 and by[9012]["component_id"] == 9011
    assert all((r["component_id"] == r["vec_id"]) == r["kept"] for r in got)
    assert embeddings.embedding_groups(df.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("most,a_list,base_rows,pairs", [(4096, 4000, 20_000, 4_000_000), (64, 4, 20_000, 4_000_000), (16, 100_000, 40, 2_000)])
def test_embedding_recall(spark, monkeypatch, most, a_list, base_rows, pairs):
    # the given vectors with lists as chosen, with lists divided by second centroids, and with few large lists dealt as grids
    given = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("embedding is not null").orderBy("vec_id").collect()]
    rng = np.random.default_rng(21)
    near = [(10**6 + 4 * i + k, v / np.linalg.norm(v) + rng.normal(size=len(v)) * rng.uniform(0.1, 0.36) / len(v) ** 0.5) for i, v in given[:600] for k in range(4)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in given + near], "vec_id long, embedding array<double>")
    fit = embeddings.fit
    lists = []
    monkeypatch.setattr(embeddings, "fit", lambda x, n: lists.append(fit(x, n, most, a_list)) or lists[-1])
    monkeypatch.setattr(embeddings, "BASE_ROWS", base_rows)
    monkeypatch.setattr(embeddings, "TASK_PAIRS", pairs)
    got = {r["vec_id"]: r for r in embeddings.embedding_groups(df).collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = np.concatenate([u[i : i + 1000] @ u.T >= 0.95 for i in range(0, len(u), 1000)])
    links = near.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert links.sum() > 0 and (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert (len(lists[0].second) > 1) == (a_list == 4)
    place = {i: k for k, (i, _) in enumerate(rows)}
    roots = {}
    for i, _ in rows:
        roots.setdefault(got[i]["component_id"], set()).add(place[i])
    assert all(near[np.ix_(sorted(m), sorted(m))].sum(axis=1).min() > 1 for m in roots.values() if len(m) > 1)


def labels_of(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_quality(spark, odd, none):
    labels, docs = labels_of(spark)
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows) and quality.quality_scores(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_quality_density(spark):
    """Scores against the two classes' normal densities, written out with determinants and inverses."""
    labels, docs = labels_of(spark)
    rows = quality.features(docs, "doc_id").collect()
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    x = {k: np.array([r["x"] for r in rows if y.get(r["doc_id"]) == k]) for k in (0, 1)}
    n = len(x[0]) + len(x[1])
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    within = sum(len(x[k]) * cov[k] for k in x) / n + 1e-6 * np.eye(quality.N)
    pooled = 0.98 * within + 0.02 * np.diag(np.diag(within))
    every = np.array([r["x"] for r in rows])
    log = []
    for k in (0, 1):
        own, d = 0.9 * cov[k] + 0.1 * pooled + 1e-6 * np.eye(quality.N), every - x[k].mean(axis=0)
        log.append(np.log((len(x[k]) + 1) / (n + 2)) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert np.allclose([got[r["doc_id"]] for r in rows], want, atol=1e-6)


def test_quality_stage_keeps_what_scores_say(spark):
    labels, docs = labels_of(spark)
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["predicted"]}
    clash = docs.withColumns({"x": F.lit("mine"), "score": F.lit(2)})
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == good and kept.filter("x = 'mine' and score = 2").count() == len(good)
    none = quality.quality_scores(docs, labels.withColumn("quality", F.lit(None).cast("int"))).collect()
    assert all(r["score"] == 0.5 for r in none)


def test_toxicity(spark, odd, none):
    labels, docs = labels_of(spark)
    more = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "quality", "toxic")
    more = common.settle(more)
    y = more.select("doc_id", "quality", "toxic")
    results = {}
    for linked in (True, False):
        model = toxicity.train(more, y, linked=linked)
        got = toxicity.toxicity(more, model).filter("held_out").join(y, "doc_id").collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
        results[linked] = np.mean([r["predicted"] == r["toxic"] for r in got]), sum(r["predicted"] for r in got if not r["toxic"]) / len(got)
        assert (np.abs(model.models[1].earlier) > 0).all() == linked
    print("toxicity, held out, with and without the chain:", results)
    assert results[True][0] > 0.93 and results[True][1] < 0.01
    model = toxicity.train(docs, labels)
    assert toxicity.toxicity(odd, model).count() == 11 and toxicity.toxicity(none, model).count() == 0
    blank = toxicity.train(none, labels)
    assert all(r["score"] == 0.5 and r["p_quality"] == 0.5 for r in toxicity.toxicity(odd, blank).collect())
    again = toxicity.sample(docs.union(docs).union(docs), labels.union(labels).union(labels.withColumn("toxic", 1 - F.col("toxic"))))
    assert again.count() <= labels.count()


def test_chain_out_of_fold():
    """A category that only remembers rows helps nobody: out of fold its probabilities know nothing of the rows."""
    rng = np.random.default_rng(0)
    n = 300
    rows = ids = np.arange(n)  # a feature of its own for each row
    targets = rng.integers(0, 2, (n, 2))
    targets[:, 1] = targets[:, 0]
    fold = rng.integers(0, toxicity.FOLDS, n)
    used = np.ones((2, toxicity.FOLDS + 1, n), bool)
    models = toxicity.fit_chain(rows, ids, n, targets, fold, used)
    seen = models[0].probability(rows, ids, n, np.zeros((n, 0)))
    assert ((seen > 0.5) == targets[:, 0]).mean() > 0.95 and abs(models[1].earlier[0]) < 1.0


def test_chain_against_a_dense_one():
    """The chain over a small table in plain dense numpy: the same steps on a full matrix, out-of-fold probabilities by leaving rows out."""
    rng = np.random.default_rng(5)
    n, size, c = 60, 9, 3
    x = (rng.random((n, size)) < 0.4).astype(float)
    targets = np.stack([(x @ rng.normal(size=size) + rng.normal(size=n) > 0).astype(int) for _ in range(c)], axis=1)
    fold = rng.integers(0, toxicity.FOLDS, n)
    used = rng.random((c, toxicity.FOLDS + 1, size)) < 0.8
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(x, before, y):
        full = np.column_stack([x, np.ones(len(x)), before - 0.5])
        k = x.shape[1]
        w, s = np.zeros(full.shape[1]), np.full(full.shape[1], 1e-6)
        step = np.array([0.5] * (k + 1) + [0.2] * before.shape[1])
        decay = np.array([1.0] * k + [0.0] + [1.0] * before.shape[1])
        for _ in range(80):
            g = full.T @ (y - sigmoid(full @ w)) - decay * w
            s += g * g
            w += step * g / np.sqrt(s)
        return w

    def apply(w, x, before):
        return sigmoid(np.column_stack([x, np.ones(len(x)), before - 0.5]) @ w)

    rows, ids = np.nonzero(x)
    models = toxicity.fit_chain(rows, ids, n, targets, fold, used)
    before, own = np.zeros((n, 0)), np.zeros((n, 0))
    for j in range(c):
        w = fit(x * used[j, toxicity.FOLDS], before, targets[:, j])
        assert np.allclose(models[j].weights * used[j, toxicity.FOLDS], w[:size] * used[j, toxicity.FOLDS], atol=1e-8) and np.allclose(models[j].bias, w[size]) and np.allclose(models[j].earlier, w[size + 1 :])
        own = np.column_stack([own, models[j].probability(rows, ids, n, own)])
        out = np.full(n, 0.5)
        for k in range(toxicity.FOLDS):
            here = fold == k
            part = fit(x[~here] * used[j, k], before[~here], targets[~here, j])
            out[here] = apply(part, x[here] * used[j, k], before[here])
        before = np.column_stack([before, out])
    assert own.shape == (n, c) and ((own > 0) & (own < 1)).all()


def test_mixing(spark, docs, odd, none):
    want = {"src0": 0.9, "src1": 0.1}
    got = mixing.poisson_mix(docs, want, total=2000).groupBy("source").count().collect()
    by = {r["source"]: r["count"] for r in got}
    assert set(by) <= set(want) and abs(by["src0"] - 1800) < 5 * 1800**0.5 and abs(by["src1"] - 200) < 5 * 200**0.5
    rate = mixing.rates(docs, want, total=2000).collect()
    assert {r["source"] for r in rate if r["rate"] > 0} == set(want)
    assert mixing.poisson_mix(docs, {"nowhere": 1.0}).count() == 0
    inside = ["copy_no", "Shuffle_Key", "u", "n", "of", "cdf", "key", "row", "c0", "no"]
    clash = docs.withColumns({c: F.lit(f"my {c}") for c in inside})
    got = mixing.poisson_mix(clash)
    assert got.columns == [*clash.columns, "copy_no_", "shuffle_key_"]
    plain = Counter((r["doc_id"], r["copy_no"], r["shuffle_key"]) for r in mixing.poisson_mix(docs).collect())
    assert Counter((r["doc_id"], r["copy_no_"], r["shuffle_key_"]) for r in got.collect()) == plain
    assert all(r[c] == f"my {c}" for r in got.limit(50).collect() for c in inside)
    mixed = mixing.poisson_mix(odd)
    assert mixed.columns == [*odd.columns, "copy_no", "shuffle_key"] and mixing.poisson_mix(none).count() == 0
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert n[5] % 2 == 0


def test_poisson_inversion(spark):
    """Counts against the distribution's own sums, for rates from next to nothing to a single document among billions."""
    import time

    for rate in (0.0, 1e-9, 0.3, 7.0, 150.0, 900.0, 100_000.0):
        began = time.time()
        t = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t")).first()["t"]
        assert len(t["cdf"]) <= 24 * rate**0.5 + 70 and t["cdf"][-1] == 1.0 and time.time() - began < 20
        last = int(rate + 20 * rate**0.5 + 60)
        logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, last + 1)))])
        want = np.cumsum(np.exp(np.arange(last + 1) * (np.log(rate) if rate else 0.0) - rate - logs)) if rate else np.ones(last + 1)
        want /= want[-1]  # sums of logs are not that exact
        assert np.abs(np.array(t["cdf"][:-1]) - want[t["base"] : t["base"] + len(t["cdf"]) - 1]).max(initial=0) < 1e-9
        assert t["base"] == 0 or want[t["base"] - 1] < 2.0**-52
        us = [0.0, 2.0**-52, 0.1, 0.5, 0.9, 0.99999]
        got = [r["n"] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_count(mixing.poisson_table(F.lit(rate)), F.col("u")).alias("n")).collect()]
        assert all(abs(g - int(np.searchsorted(want, u, side="right"))) <= (u > 0.999) for g, u in list(zip(got, us, strict=True))[1:]) and got[0] == 0


def test_language(spark, odd, none):
    _, docs = labels_of(spark)
    model = language.fit(language.samples(docs))
    got = [r for r in language.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got) and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    rows = {r["doc_id"]: r for r in language.languages(odd, model).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[9]["lang_pred"] == "und" and rows[4]["lang_pred"] != "und"
    assert language.languages(none, model).count() == 0
    empty = language.fit({})
    assert all(r["lang_pred"] == "und" for r in language.languages(odd, empty).collect())


def test_language_sample_is_bounded(spark, docs):
    many = docs.filter("doc_id < 40").select("doc_id", "text", "lang").crossJoin(spark.range(50)).drop("id")
    one = language.samples(docs.filter("doc_id < 40"))
    assert {k: len(v) for k, v in language.samples(many).items()} == {k: len(v) for k, v in one.items()}


def test_forward_backward():
    """Posteriors, expected moves and totals against all labellings of short runs."""
    from itertools import product

    rng = np.random.default_rng(6)
    k, length = 3, 5
    model = language.Chain(["a", "b", "c"], np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    scores = rng.normal(size=(2, length, k))
    real = np.array([[True] * 5, [True, True, True, False, False]])
    post, moves, begin, total = model.forward_backward(scores, real)
    want_moves, want_begin = np.zeros((k, k)), np.zeros(k)
    for r, n in ((0, 5), (1, 3)):
        weight = {}
        for path in product(range(k), repeat=n):
            z = model.begin[path[0]] + sum(scores[r, t, c] for t, c in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
            weight[path] = np.exp(z)
        whole = sum(weight.values())
        for t in range(n):
            assert np.allclose(post[r, t], [sum(w for p, w in weight.items() if p[t] == c) / whole for c in range(k)])
        for p, w in weight.items():
            want_begin[p[0]] += w / whole
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w / whole
        assert np.isclose(total[r] + scores[r].max(axis=1)[:n].sum(), np.log(whole))
    assert np.allclose(moves, want_moves) and np.allclose(begin, want_begin)


def test_code_switched_words(spark):
    """Words of held-out documents of two languages, joined by clauses: each word gets its own document's language."""
    _, docs = labels_of(spark)
    model = language.fit(language.samples(docs))
    own = {}
    for r in docs.select("doc_id", "lang", "text").filter("length(text) > 800").orderBy("doc_id").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and re.fullmatch(r"[\w\s.,]+", r["text"][:600]):
            own.setdefault(r["lang"], []).append(r["text"][:600].split()[:-1])
    langs = sorted(own)
    right = whole = 0
    for i in range(8):
        for a, b in zip(langs, langs[1:]):
            x, y = own[a][i % len(own[a])], own[b][i % len(own[b])]
            gold = [(w, lang) for at in range(0, 48, 12) for lang, words in ((a, x), (b, y)) for w in words[at : at + 12]]
            got = language.label_words(model, " ".join(w for w, _ in gold))
            assert [w for w, _ in got] == [w for w, _ in gold]
            right += sum(p == q for (_, p), (_, q) in zip(got, gold))
            whole += len(gold)
    assert language.label_words(model, " 12 !! ") == [("12", "und"), ("!!", "und")] and language.label_words(model, "") == []
    assert right > 0.85 * whole


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks(spark, docs, odd, none):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (2, None), (3, " "), (4, "tiny"), (5, "Another  sentence that is here for this very test")], "item_id long, text string")
    rows = [(1, "so the quick brwn fox jumps overr the lazy dog again, yes"), (2, "the quick red cat walks under the lazy dog again"), (3, "another sentence that\nis here for this very test"), (4, "A TINY thing"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        for j, b in ((r["item_id"], r["text"]) for r in bench.collect()):
            n = decontaminate.normal(b or "")
            d = sellers(n, decontaminate.normal(t or "")) if n and t else 10**6
            if d <= int(len(n) * 0.1):
                want[i, j] = d
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(df, bench).collect()} == want and (1, 1) in want
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_decontaminate_by_text(spark, docs):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (2, "Another sentence that is here for this very test")], "item_id long, text string")
    rows = [(1, "so the quick brwn fox jumps over the lazy dog again, yes"), (1, "clean"), (2, None), (None, ""), (3, "another sentence that is here for this very test"), (3, "another sentence that is here for this very test")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("__same", "item_id", "key")})
    got = decontaminate.decontaminate(df, bench)
    assert got.columns == df.columns and Counter((r["doc_id"], r["text"], r["key"]) for r in got.collect()) == Counter({(1, "clean", 7): 1, (2, None, 7): 1, (None, "", 7): 1})


def test_leaks_brute_force(texts):
    rng = np.random.default_rng(2)
    items = [t[40:120] for t in list(texts.values())[:40] if len(t) > 200]
    cases = []
    for t in items[:12]:
        n = list(decontaminate.normal(t))
        for k in rng.integers(0, len(n), int(rng.integers(0, 12))):
            n[k] = "xyz"[k % 3]
        cases.append("lead " + "".join(n) + " tail")
    automaton, compiled = decontaminate.compile_items([(i, decontaminate.normal(t)) for i, t in enumerate(items)], 0.1)
    for t in cases:
        want = {i: d for i, b in enumerate(items) if (d := sellers(decontaminate.normal(b), t)) <= int(len(decontaminate.normal(b)) * 0.1)}
        assert {k: v[0] for k, v in decontaminate.matches(t, automaton, compiled).items()} == want


def test_token_ids(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    tricky = ["a  b\n\n c\td", "x y it's we'll", " lead", "trail  ", "<|endoftext|> a", "123abc_d éte مر", "\n\nThe  end. \n", "don't  's5", "a\x1cb ​c"]
    given = docs.select("doc_id", "text").union(odd.filter("doc_id <> 5").select((F.col("doc_id") + 5000).alias("doc_id"), "text")).union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    path = str(tmp_path / "ids")
    tokens.write_ids(given, path, tokens.tokenizer_path())
    at, want = 0, {}
    for i, t in sorted((r["doc_id"], r["text"]) for r in given.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_ids(spark, path).collect()} == want
    found = {r["key"]: len(r["ids"]) for r in tokens.lookup(spark, path, [*want, 7777, -1]).collect()}
    assert found == {k: v[1] for k, v in want.items()}
    twice = str(tmp_path / "twice")
    tokens.write_ids(odd, twice, tokens.tokenizer_path())
    assert tokens.read_ids(spark, twice).count() == 11
    tokens.write_ids(odd.filter("doc_id < 0"), str(tmp_path / "no"), tokens.tokenizer_path())
    assert tokens.read_ids(spark, str(tmp_path / "no")).count() == 0
    with pytest.raises(Exception, match="without a key"):
        tokens.write_ids(odd.withColumn("doc_id", F.lit(None).cast("long")), str(tmp_path / "bad"), tokens.tokenizer_path())


def test_token_ids_without_keys(spark, tmp_path):
    rows = [(None, "b"), (3, "a"), (None, None), (1, "c d"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, order in (("key", None), ("shuffled", [F.md5(F.coalesce("text", F.lit("")))])):
        path = str(tmp_path / name)
        tokens.write_ids(df.coalesce(1), path, tokens.tokenizer_path(), order=order, keyless=True)
        got = sorted(tokens.read_ids(spark, path).collect(), key=lambda r: r["start"])
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
        if not order:
            assert [r["doc_id"] for r in got] == [1, 3, None, None, None]
        assert {r["key"]: len(r["ids"]) for r in tokens.lookup(spark, path, [0, 1, 3]).collect()} == {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"]}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert tokens.op10_token_ids(spark, str(tmp_path)).filter("doc_id is null").count() == 3
    assert corpus_pipeline.encode(spark, df, "").filter("doc_id is null").count() == 3


def test_token_index(spark, docs, tmp_path, monkeypatch):
    """Look-ups through the index of files in shuffled order, with repeated and missing keys and documents without one."""
    monkeypatch.setattr(tokens, "KEYS_A_BUCKET", 16)
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 9)
    odd_rows = spark.createDataFrame([(None, "no key"), (5, "five again"), (5, "five again"), (-3, "below zero"), (2**62, "")], "doc_id long, text string")
    given = docs.select("doc_id", "text").union(odd_rows)
    path, index = str(tmp_path / "ids"), str(tmp_path / "index")
    tokens.write_ids(given, path, tokens.tokenizer_path(), order=[F.md5(F.coalesce("text", F.lit("")))], keyless=True)
    tokens.write_index(spark, path, index)
    assert spark.read.parquet(index).count() > 5
    encode = tokens.encoder(tokens.tokenizer_path())
    want = {}
    for r in given.filter("doc_id is not null").collect():
        ids = np.frombuffer(encode([(r["text"] or "").encode()])[0], encode.dtype).tolist() + [2]
        want.setdefault(r["doc_id"], []).append(ids)
    got = {r["key"]: r["ids"] for r in tokens.seek(spark, path, index, [*want, 10**9, 10**9 + 1, -1]).collect()}
    assert set(got) == set(want) and all(got[k] in v for k, v in want.items())
    one = tokens.seek(spark, path, index, [next(iter(want))])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "EqualTo(shard," in plan and "EqualTo(block," in plan  # of the payload, one block's pages
    assert tokens.seek(spark, path, index, []).count() == 0 and tokens.seek(spark, path, index, [10**9]).count() == 0
    tokens.write_ids(given.filter("doc_id = 0.5"), str(tmp_path / "no"), tokens.tokenizer_path())
    tokens.write_index(spark, str(tmp_path / "no"), str(tmp_path / "no index"))
    assert tokens.seek(spark, str(tmp_path / "no"), str(tmp_path / "no index"), [1]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 4096])
def test_perfect_hash(n):
    keys = np.arange(n) * 37 - 5
    index = tokens.build_index(keys)
    assert len(index[1]) == n and [tokens.find(int(k), *index) for k in keys] == list(range(n))
    assert sum(tokens.find(k, *index) is not None for k in range(10**7, 10**7 + 300)) <= 1


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    assert all((got[a] == got[b]) for a, b in edges if a != b)
    assert len({got[x] for x in got}) == len({find(x) for x in got})
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert spark.range(3).select(F.xxhash64("id").alias("h")).first()["h"] == int(common.mix(np.array([0], np.uint64)).view(np.int64)[0])


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = common.settle(stage(spark, kept, sf))
        assert out.columns == docs.columns and out.exceptAll(kept).count() == 0 and 0 < out.count() <= kept.count(), name
        kept = out
    bench = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(b in decontaminate.normal(r["text"]) for r in kept.collect() for b in bench)
    mixed = common.settle(corpus_pipeline.STAGES[3][1](spark, kept, sf))
    assert mixed.columns == docs.columns
    hot = docs.limit(1).withColumns({"copy_no": F.lit(5), "shuffle_key": F.lit("mine")})
    assert corpus_pipeline.STAGES[3][1](spark, hot, sf).columns == hot.columns
    last = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in mixed.collect())
    last.sort(key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(last, last[1:]))


def test_sql(spark):
    for name, sql in ORACLE_SQL.items():
        db = duckdb.connect()
        for t in ("documents", "benchmark"):
            db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        df = QUERIES[name](spark, SF)
        want = db.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        got = Counter(tuple(r[c] for c in want.columns) for r in df.collect())
        assert got == Counter(want.fetchall())
