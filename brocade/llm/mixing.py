"""Mixing of sources to target weights by Poisson replication, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, settle, shuffle_count

SEED = "mix-1"
TEMPERATURE = 0.5
#: Up to so many numbers in all sources' arrays (8 MB) they are broadcast; beyond it the join shuffles.
MOST_BROADCAST = 1 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons; null counts as empty."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """A Poisson variable's base and P(X <= k) for k from base on, as a struct: from 12 deviations below the rate to as far above; the last is 1.

    Probabilities are weights that follow from each other, p(k + 1) = p(k) rate / (k + 1), over their sum, so nothing is
    done for numbers below the base, of which none has a chance of 2^-52. The array is as wide as the root of the rate.
    """
    reach = 12 * F.sqrt(rate) + 30
    base, last = F.greatest(F.lit(0), F.floor(rate - reach)).cast("int"), F.ceil(rate + reach).cast("int")
    step = lambda acc, k: F.struct((w := acc["w"] * rate / k).alias("w"), (acc["c"] + w).alias("c"), F.concat(acc["a"], F.array(acc["c"] + w)).alias("a"))
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("c"), F.array(F.lit(1.0)).alias("a"))
    sums = F.aggregate(F.sequence(base + 1, last), begin, step, lambda acc: F.concat(F.transform(acc["a"], lambda c: c / acc["c"]), F.array(F.lit(1.0))))
    return F.when(rate > 0, F.struct(base.alias("base"), sums.alias("cdf"))).otherwise(F.struct(F.lit(0).alias("base"), F.array(F.lit(1.0)).alias("cdf")))


def poisson_count(table: Column, u: Column) -> Column:
    """How many numbers k have P(X <= k) <= u: the count that u in [0, 1) stands for."""
    return F.when(u > 0, table["base"] + F.size(F.filter(table["cdf"], lambda c: u >= c))).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, source: str = "source") -> DataFrame:
    """(source, rate): mean number of copies of a document of each source.

    The target share of a source is its weight; sources that `weights` does not name get none. Without weights it is
    in proportion to its size to the power `temperature`. The expected size of the result is `total` documents, the
    number of the input's unless given.
    """
    sizes = settle(docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n")))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        weighed = sizes.withColumn("w", F.coalesce(named[F.coalesce("source", F.lit(""))], F.lit(0.0)))
    whole = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()  # one row
    rate = F.try_divide(F.col("w"), F.lit(whole["w"])) * F.lit(float(total if total is not None else whole["n"] or 0)) / F.col("n")
    return weighed.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, seed: str = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Each document 0, 1, 2.. times, globally shuffled, with the columns of docs and copy_no (from 1) and shuffle_key.

    The number of copies inverts the Poisson distribution with the source's rate at a uniform number made from the
    seed and the key. Rows of equal key and source get equal counts; a null key counts as an empty one; null sources
    are a source of their own, with no weight unless sizes make the weights. Where docs has a column named copy_no or
    shuffle_key it stays as it is, and the new one has underscores after its name. The copies go to random tasks by
    shuffle_key and lie in its order there.
    """
    spark = docs.sparkSession
    copy_no, shuffle_key = fresh("copy_no", docs), fresh("shuffle_key", docs)
    tables = rates(docs, weights, temperature, total, source).select("source", poisson_table(F.col("rate")).alias("table"))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, plain, strict=True))
    rows = docs.toDF(*plain).withColumns({"key": F.col(own[key]).cast("string"), "of": F.col(own[source])})
    reach = tables.agg(F.sum(F.size("table.cdf")).alias("n")).first()["n"] or 0  # numbers in all arrays
    if reach <= MOST_BROADCAST:
        tables = F.broadcast(tables)
    drawn = rows.join(tables, rows["of"].eqNullSafe(tables["source"])).withColumn("u", uniform(F.lit(seed), F.col("key")))
    drawn = drawn.select(*plain, "key", poisson_count(F.col("table"), F.col("u")).alias("n")).filter("n > 0")
    copies = drawn.select(*plain, "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("no"))
    order = F.md5(F.concat_ws(":", F.lit(seed + "/order"), F.col("no").cast("string"), F.coalesce("key", F.lit(""))))
    copies = copies.select(*[F.col(own[c]).alias(c) for c in docs.columns], F.col("no").alias(copy_no), order.alias(shuffle_key))
    return copies.repartition(shuffle_count(spark), shuffle_key).sortWithinPartitions(shuffle_key)


def mix_sql(docs: str, columns: str, temperature: float = TEMPERATURE, seed: str = SEED) -> str:
    """The same in DuckDB's SQL over a table expression without null sources."""
    return f"""
    WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature}) AS w FROM {docs} GROUP BY source),
    rates AS (SELECT source, w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
    pmf AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k)),
    cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
    drawn AS (SELECT d.*, ('0x' || substr(md5('{seed}:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM {docs} d),
    counted AS (SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source = d.source AND d.u >= c.c) AS n_copies FROM drawn d)
    SELECT {columns} FROM counted, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy_no)"""


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated towards source weights of size to the power 0.5, shuffled globally, texts included."""
    from .common import table

    return poisson_mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "copy_no", "shuffle_key", "n_chars", "text")


OP7_SQL = mix_sql("documents", f"doc_id, source, lang, CAST(copy_no AS INT) AS copy_no, md5('{SEED}/order:' || copy_no || ':' || doc_id) AS shuffle_key, n_chars, text")
