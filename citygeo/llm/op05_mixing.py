"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

The target weight of a source, over its share of all characters, is its mean repetition rate. A uniform number from a hash of
seed and document id is put through the inverse of the Poisson distribution of that mean; the document is exploded into
that many replicas. Replicas go to partitions by a hash of (seed, id, replica) and are ordered by it there: a global
shuffle in one exchange. The distribution tables of all sources are measured; up to MOST_TERMS terms they are broadcast, so
documents are not shuffled to meet them. Beyond that the join shuffles, and AQE splits skewed sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import checkpoint, documents

MOST_TERMS = 2_000_000  # 16 MB
DIGITS = 12  # hex digits of a uniform number: 48 bits


def _hash_hex(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of some values."""
    return F.conv(F.substring(_hash_hex(*parts), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def _last_term(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")


def poisson_table(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson mean, as far as 12 deviations beyond it. The first terms are summed from
    logarithms, so large means do not underflow."""
    last = _last_term(rate)
    log_p = lambda k, log_factorial: k * F.log(rate) - rate - log_factorial
    start = F.struct(F.lit(0.0).alias("lf"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("table"))

    def step(acc: Column, k: Column) -> Column:
        lf = acc["lf"] + F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log_p(k, lf))
        return F.struct(lf.alias("lf"), total.alias("sum"), F.concat(acc["table"], F.array(total)).alias("table"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["table"]).otherwise(F.array(F.lit(1.0)))


def flattened_weights(docs: DataFrame, power: float, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, weight: each source's characters to a power below 1, so small sources gain. A null source is a source."""
    chars = F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("chars")
    return docs.groupBy(F.col(source_col).alias("source")).agg(chars).select("source", F.pow("chars", F.lit(power)).alias("weight"))


def repetition_rates(docs: DataFrame, weights: DataFrame, growth: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, rate: weights (source, weight) scaled so that the expected characters are growth times all there are.

    Sources without a weight, or with one that is null or not positive, get rate 0; so do sources without characters.
    """
    chars = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("chars"))
    w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum("weight").alias("weight"))
    have = chars.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left")
    have = have.select("source", "chars", F.when((F.col("weight") > 0) & (F.col("chars") > 0), F.col("weight")).otherwise(0.0).alias("weight"))
    total = have.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.lit(growth) * F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars")
    return have.crossJoin(F.broadcast(total)).select("source", F.when(F.col("weight") > 0, rate).otherwise(0.0).alias("rate"))  # total is one row


def mix_sources(docs: DataFrame, rates: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of docs, and replica (from 0) and shuffle_key, one row for each replica, shuffled.

    A document is drawn by its id, so rows with equal ids are repeated alike; one without an id is drawn by its text. Null sources
    are matched with a null source in rates (source, rate). Sources that rates does not have are left out. Null and empty texts
    are repeated as others are. Columns of docs called replica or shuffle_key are replaced; others may have any names.
    """
    docs = docs.drop("replica", "shuffle_key")
    rates = checkpoint(rates.select("source", "rate"))
    terms = rates.agg(F.sum(_last_term(F.col("rate")) + 9)).first()[0] or 0  # 9: the source's name, generously
    table = rates.select("source", poisson_table(F.col("rate")).alias("table"))
    table = F.broadcast(table) if terms <= MOST_TERMS else table
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("row_source"), name.alias("name"))
    drawn = rows.join(table, F.col("row_source").eqNullSafe(F.col("source")))
    drawn = drawn.withColumn("count", F.size(F.filter("table", lambda c: c <= uniform(F.lit(seed), F.col("name"))))).filter("count > 0")
    drawn = drawn.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    keyed = drawn.select("row", "replica", F.substring(_hash_hex(F.lit(seed), F.col("name"), F.col("replica")), 1, 16).alias("shuffle_key"), F.spark_partition_id().alias("part"))
    dealt = keyed.repartition("shuffle_key", "part").sortWithinPartitions("shuffle_key")  # part: equal rows come from many tasks
    return dealt.select("row.*", "replica", "shuffle_key")


POWER, GROWTH, MIX_SEED = 0.7, 1.0, 17


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mix_sources(docs, repetition_rates(docs, flattened_weights(docs, POWER), GROWTH), MIX_SEED).select("doc_id", "source", "replica", "shuffle_key", "text")


ORACLE = f"""
with chars as (select source, sum(coalesce(length(text), 0)) as chars from documents group by source),
weighted as (select source, chars, case when chars > 0 then pow(chars, {POWER}) else 0 end as weight from chars),
rates as (select source, case when weight > 0 then {GROWTH} * (select sum(chars) from weighted) * weight / (select sum(weight) from weighted) / chars else 0 end as rate from weighted),
terms as (select source, rate, k, exp(k * ln(rate) - rate - case when k < 2 then 0 else lgamma(k + 1) end) as p
  from rates, range(0, 400) t(k) where rate > 0 and k <= ceil(rate + 12 * sqrt(rate) + 24)),
cdf as (select source, k, sum(p) over (partition by source order by k) as c from terms),
named as (select *, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) as name from documents),
drawn as (select doc_id, source, text, name, cast(('0x' || substr(md5('{MIX_SEED}|' || name), 1, {DIGITS})) as bigint) / {float(16**DIGITS)!r} as u from named),
counted as (select d.doc_id, d.source, d.text, d.name, (select count(*) from cdf where cdf.source is not distinct from d.source and cdf.c <= d.u) as n from drawn d),
replicas as (select doc_id, source, text, name, unnest(range(0, n)) as replica from counted where n > 0)
select doc_id, source, cast(replica as integer) as replica,
  substr(md5('{MIX_SEED}|' || name || '|' || replica), 1, 16) as shuffle_key, text from replicas
"""
