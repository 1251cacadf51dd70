"""Report feedback: buckets of symbols, basket overlaps, ranking overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import DATE, FACTOR, SYMBOL, VALUE
from . import ranking

c = F.col

# Labels and actions of each bucket, first match wins.
BUCKETS = {
    "missed_alpha": ({"missed_alpha"}, {"boost_recall"}),
    "stale": (
        {"alpha_already_paid", "good_signal_bad_timing", "stale_chase", "right_but_no_fill"},
        {"penalize_stale_chase"},
    ),
    "false_positive": (
        {"false_positive", "false_positive_executable", "wrong_way_executable"},
        {"penalize_false_positive"},
    ),
    "captured": ({"captured", "won_and_executable"}, {"reward_capture", "reward_executable_capture"}),
}


def recent_feedback(df: DataFrame, today: Column, days: int = 45) -> DataFrame:
    """Usable rows: recent, action and positive weight present, not merely observed."""
    observed = (F.upper(F.coalesce("action_label", F.lit(""))) == "OBSERVE") | (
        F.upper(F.coalesce(F.get_json_object("detail_json", "$.action_intent"), F.lit(""))) == "OBSERVE"
    )
    return df.where(
        (c("evaluation_date") >= F.date_sub(today, days))
        & c("feedback_action").isNotNull()
        & (c("feedback_weight") > 0)
        & (F.coalesce(c(SYMBOL), F.lit("")) != "")
        & ~observed
    )


def bucket() -> Column:
    out = None
    for name, (labels, actions) in BUCKETS.items():
        hit = c("label").isin(*labels) | c("feedback_action").isin(*actions)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def feedback_weights(df: DataFrame) -> DataFrame:
    """(bucket, symbol, weight) summed over the usable rows."""
    return (
        df.withColumn("bucket", bucket())
        .where(c("bucket").isNotNull())
        .groupBy("bucket", SYMBOL)
        .agg(F.sum("feedback_weight").alias("weight"))
    )


def baskets(snapshot: DataFrame, directions: DataFrame) -> DataFrame:
    """Each factor's favoured names: 3% of them, at least 10 and at most 50."""
    sizes = snapshot.where(c(VALUE).isNotNull()).groupBy(FACTOR).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_k", F.greatest(F.lit(10), F.least(F.lit(50), F.floor(c("_n") * 0.03))))
    side = F.when(c("direction") == "short", c(VALUE)).otherwise(-c(VALUE))
    oriented = snapshot.where(c(VALUE).isNotNull()).join(F.broadcast(directions.select(FACTOR, "direction")), FACTOR)
    best = ranking.top_rows(oriented.withColumn("_o", side), [FACTOR], [c("_o"), c(SYMBOL)], 50)
    return best.join(F.broadcast(sizes), FACTOR).where(c("rank") <= c("_k")).select(FACTOR, SYMBOL, "rank")


def overlaps(basket: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight of each bucket inside each basket, over max(1, basket size / 5)."""
    hit = basket.join(weights, SYMBOL, "left")
    denom = F.greatest(F.lit(1.0), F.countDistinct(SYMBOL) / 5.0)
    return hit.groupBy(FACTOR).agg(
        *[
            F.round(F.coalesce(F.sum(F.when(c("bucket") == b, c("weight"))), F.lit(0.0)) / denom, 4).alias(f"{b}_overlap")
            for b in BUCKETS
        ],
        F.countDistinct(SYMBOL).alias("basket_n"),
    )


def with_overlay(candidates: DataFrame, overlap: DataFrame) -> DataFrame:
    """Feedback score and multiplier, shrunk by the effective factor count, applied to rank_score."""
    zero = F.lit(0.0)
    o = {b: F.coalesce(f"{b}_overlap", zero) for b in BUCKETS}
    score = F.round(1.30 * o["missed_alpha"] + 0.35 * o["captured"] - 0.75 * o["stale"] - o["false_positive"], 4)
    clip = lambda x: F.least(F.greatest(x, F.lit(0.85)), F.lit(1.20))
    df = candidates.join(overlap, FACTOR, "left").withColumn("feedback_score", score)
    raw = clip(1.0 + 0.25 * c("feedback_score"))
    mult = clip(1.0 + (raw - 1.0) * F.coalesce("n_eff_shrinkage", F.lit(1.0)))
    return df.withColumns(
        {
            "feedback_multiplier_raw": F.round(raw, 4),
            "feedback_multiplier": F.round(mult, 4),
            "rank_score": F.round(c("rank_score") * mult, 6),
        }
    )
