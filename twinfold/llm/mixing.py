"""Mixing sources to target weights by Poisson replication.

Only DataFrame functions are used. A source's mean repetition rate is epochs * N * weight / n, N being all
rows and n its own. A uniform number hashed from seed and id inverts the Poisson distribution with
that mean: the row appears so many times. All copies are dealt out by a hash of
seed, id and copy number and sorted by it within partitions: a global shuffle that a lost
executor's retry repeats exactly. The hot source only sends its counts before that.

A null source is a source of its own; a null id hashes as the empty text. Rows with one id get
the same count. A weight of 0, or a source without a weight, drops that source. Ties in the shuffle key are between copies of
rows with one id. Texts only travel with their rows, however long. An empty table
gives an empty result. Columns named copy_no or shuffle_key in the input are replaced; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import walk
from .common import table

SEED = 10
#: Without stated weights a source weighs (its rows) ** TEMPERATURE.
TEMPERATURE = 0.7
#: The table of sources is broadcast up to so many numbers in all their distributions (8 bytes each) and names; beyond, it is joined like any other.
MAX_BROADCAST_VALUES = 1_000_000
_KEY, _CDF = "__tf_source", "__tf_cdf"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def last_count(rate: Column) -> Column:
    """A count far beyond the mean."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until far beyond the mean, from logarithms so that large means don't underflow."""
    log = lambda s, k: F.when(k == 0, -rate).otherwise(s["log"] + F.ln(rate) - F.ln(k.cast("double")))
    total = lambda s, k: s["sum"] + F.exp(log(s, k))
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    steps = walk(F.sequence(F.lit(0), last_count(rate)), zero, lambda s, k: F.struct(log(s, k).alias("log"), total(s, k).alias("sum")), total, "array<double>")
    return F.when(rate > 0, steps)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, source_col: str) -> DataFrame:
    """source key, n, rate: a row for each source."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")).alias(_KEY)).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = F.create_map(*(F.lit(x) for k, w in weights.items() for x in ("\0null" if k is None else k, float(w)))) if weights else F.create_map().cast("map<string,double>")
        weighed = counts.withColumn("weight", F.coalesce(F.try_element_at(given, F.col(_KEY)), F.lit(0.0)))
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    rate = F.lit(float(epochs)) * F.col("all_n") * F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight")).otherwise(1.0) / F.col("n")
    return weighed.join(F.broadcast(total)).withColumn("rate", rate)  # total is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with copy_no and shuffle_key: each row as often as its Poisson count, in global random order."""
    docs = docs.drop("copy_no", "shuffle_key")
    rates = source_rates(docs, weights, epochs, source_col)
    values = rates.agg(F.sum(F.when(F.col("rate") > 0, last_count(F.col("rate"))).otherwise(0) + F.octet_length(_KEY))).first()[0] or 0
    rates = rates.select(_KEY, poisson_cdf(F.col("rate")).alias(_CDF))
    if values <= MAX_BROADCAST_VALUES:
        rates = F.broadcast(rates)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = uniform(F.lit(str(seed)), ident)
    count = F.size(F.filter(_CDF, lambda c: c <= u))
    keyed = docs.withColumn(_KEY, F.coalesce(F.col(source_col).cast("string"), F.lit("\0null"))).join(rates, _KEY).withColumn(_CDF, count).where(F.col(_CDF) > 0)
    copies = keyed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(_CDF)))).drop(_KEY, _CDF)
    key = F.substring(F.md5(F.concat_ws("|", F.lit("shuffle"), F.lit(str(seed)), ident, F.col("copy_no").cast("string")).cast("binary")), 1, 16)
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL = {
    "op10_mixing": f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(CAST(n AS DOUBLE), {TEMPERATURE}) AS weight FROM s),
r AS (SELECT source, (SELECT sum(n) FROM w) * weight / (SELECT sum(weight) FROM w) / n AS rate FROM w),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d AS (SELECT *, CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS times FROM d)
SELECT doc_id, text, lang, source, n_chars, copy_no, substr(md5('shuffle|{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy_no), 1, 16) AS shuffle_key
FROM (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy_no FROM n)"""
}
