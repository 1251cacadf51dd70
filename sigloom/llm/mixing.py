"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quality_rules import host_key
from .shared import small_join, stored

#: Hash digits of the uniform variate; 13 hexadecimal digits are 52 bits.
DIGITS = 13
POWER = 0.5
#: A larger rate is the sum of equal parts of at most this, each with a variate of its own.
PART_RATE = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A variate in (0, 1) that depends on the seed and ``parts`` alone."""
    return (hex_number(F.md5(seeded(seed, *parts))) + F.lit(0.5)) / F.lit(float(16**DIGITS))


def seeded(seed: int, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def hex_number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint").cast("double")


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, until the rest is far below the variate's grain.

    Terms are carried as logarithms, so large rates do not underflow.
    """
    terms = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.array(F.exp(-rate)).alias("steps"), (-rate).alias("term"))

    def grow(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + F.exp(term))).alias("steps"), term.alias("term"))

    steps = F.aggregate(F.sequence(F.lit(1), terms), start, grow, lambda acc: acc["steps"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float, text_col: str, source_col: str
) -> DataFrame:
    """(source_key, rate): how often a document of each source is wanted on average.

    ``weights`` are the sources' target shares of all characters; a source
    that is not named gets none. Without ``weights`` the shares are the
    sources' characters to the given power. ``epochs`` times the characters of
    the input are wanted in all. A source without characters has rate 0.
    """
    sizes = docs.groupBy(host_key(F.col(source_col)).alias("source_key")).agg(
        F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("chars")
    )
    sizes = stored(sizes)
    if weights is None:
        wanted = F.pow(F.col("chars").cast("double"), F.lit(power))
    else:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("+" + k, float(v))])
        wanted = F.coalesce(named[F.col("source_key")], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("wanted", wanted)
    total = sizes.agg(F.sum("chars").alias("chars"), F.sum("wanted").alias("wanted")).first()
    all_chars, all_wanted = float(total["chars"] or 0), float(total["wanted"] or 0)
    rate = F.when(
        (F.col("chars") > 0) & F.lit(all_wanted > 0),
        F.col("wanted") / F.lit(all_wanted or 1.0) * F.lit(epochs * all_chars) / F.col("chars"),
    ).otherwise(F.lit(0.0))
    return sizes.select("source_key", rate.alias("rate"))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = POWER,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixture: ``row`` (all columns of ``docs``), ``copy_no`` from 1, ``shuffle_key``, ``rate``.

    A document's count is the Poisson quantile, at its source's rate, of a
    variate hashed from seed and id, so the same rows come out on every run
    and after any lost executor. Above PART_RATE it is the sum of the quantiles
    of equal parts, whose variates are hashed from seed, id and part: a sum of
    Poisson variables is one, and no array grows with the rate. Rows are dealt out and sorted by
    ``shuffle_key``, a hash of seed, id and copy. Null text has no characters;
    null sources are one source; null ids share one variate, as do repeated
    rows. No rows give no rows.
    """
    rates = stored(source_rates(docs, weights, power, epochs, text_col, source_col))
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    rates = rates.withColumn("parts", parts)
    rates = rates.select("source_key", "rate", "parts", poisson_steps(F.col("rate") / F.col("parts")).alias("steps"))
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        host_key(F.col(source_col)).alias("source_key"),
        F.col(id_col).alias("id"),
    )
    rows = small_join(rows, rates, "source_key", F.col("id"))
    reached = lambda draw: F.size(F.filter("steps", lambda p: p < draw))
    in_parts = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + reached(uniform(seed, F.col("id"), F.lit("part"), part))
    )
    rows = rows.withColumn("draw", uniform(seed, F.col("id")))
    rows = rows.withColumn("n", F.when(F.col("parts") == 1, reached(F.col("draw"))).otherwise(in_parts))
    rows = rows.where("n > 0").select("row", "id", "rate", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    rows = rows.withColumn("shuffle_key", F.md5(seeded(seed, F.col("id"), F.col("copy_no"))))
    return rows.select("row", "copy_no", "shuffle_key", "rate").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
