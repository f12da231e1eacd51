"""Metrics from additive sums, their null-aware means, selection, paired comparison and the three-valued decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.methods import CONTROLS
from ..functions.scalars import decision, ratio, t_975
from .smoothing import SUMS

METRICS = ("brier", "mae", "occupancy_mae", "occupancy_signed_bias", "precision", "recall", "f1", "rare_brier", "rare_positive_recall", "short_positive_recall", "transition_brier")


def run_metrics(sums: DataFrame, keys: tuple[str, ...] = ("run_id", "method", "cand_ord")) -> DataFrame:
    """keys and METRICS from chunk sums (keys, feature_id, SUMS, rare): first over the chunks of a feature, then over features."""
    by_feature = sums.groupBy(*keys, "feature_id").agg(*[F.sum(s).alias(s) for s in SUMS], F.max(F.col("rare").cast("int")).alias("rare"))
    rare = F.col("rare") == 1
    total = lambda c: F.sum(c)
    t = by_feature.groupBy(*keys).agg(
        *[total(s).alias(s) for s in SUMS],
        F.avg(F.abs(F.col("sum_p") - F.col("sum_x")) / F.col("cells")).alias("occupancy_mae"),
        total(F.when(rare, F.col("sum_sq"))).alias("rare_sq"), total(F.when(rare, F.col("cells"))).alias("rare_cells"),
        total(F.when(rare, F.col("tp"))).alias("rare_tp"), total(F.when(rare, F.col("tp") + F.col("fn"))).alias("rare_pos"),
    )
    c = F.col
    return t.select(
        *keys, "cells", ratio(c("sum_sq"), c("cells")).alias("brier"), ratio(c("sum_abs"), c("cells")).alias("mae"), "occupancy_mae",
        ratio(c("sum_p") - c("sum_x"), c("cells")).alias("occupancy_signed_bias"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        ratio(c("rare_sq"), c("rare_cells")).alias("rare_brier"), ratio(c("rare_tp"), c("rare_pos")).alias("rare_positive_recall"),
        ratio(c("brief_hits"), c("brief_cells")).alias("short_positive_recall"), ratio(c("edge_sq"), c("edge_cells")).alias("transition_brier"), "changed",
    )


def equal_weight(runs: DataFrame, inner: tuple[str, ...], outer: tuple[str, ...], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means over draws within a run (inner keys), then of the runs' means (outer keys), nulls left out; and how many runs count."""
    within = runs.groupBy(*inner).agg(*[F.avg(m).alias(m) for m in metrics])
    return within.groupBy(*outer).agg(*[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"n_{m}") for m in metrics])


def best_candidates(runs: DataFrame, metric: str = "brier") -> DataFrame:
    """method, cand_ord, score: the first candidate in grid order with the smallest mean."""
    means = runs.groupBy("method", "cand_ord").agg(F.round(F.avg(metric), 12).alias("score"))
    return means.groupBy("method").agg(F.min_by("cand_ord", F.struct("score", "cand_ord")).alias("cand_ord"), F.min("score").alias("score"))


def best_control(best: DataFrame, families: tuple[str, ...] = CONTROLS, by: str | None = None) -> DataFrame:
    """The family with the smallest score (for each value of by); ties by the families' order. best: method, cand_ord, score."""
    place = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("method"))
    keys = [by] if by else []
    return best.where(place > 0).groupBy(*keys).agg(F.min_by(F.struct("method", "cand_ord", "score"), F.struct("score", place)).alias("b")).where("b is not null").select(*keys, "b.*")


def paired(runs: DataFrame, base: str, other: str, metric: str = "brier") -> DataFrame:
    """run_id, n, mean difference (base - other), half width of its 95 % interval, relative gain, numbers of positive and negative differences."""
    both = runs.groupBy("run_id", "draw").agg(F.max(F.when(F.col("method") == base, F.col(metric))).alias("b"), F.max(F.when(F.col("method") == other, F.col(metric))).alias("o")).where("b is not null and o is not null")
    return _intervals(both, "run_id")


def paired_with_all(runs: DataFrame, other: str, metric: str = "brier") -> DataFrame:
    """base and the columns of paired for every method but `other`, each against it. runs: one candidate of each method."""
    own = runs.where(F.col("method") == other).select("run_id", "draw", F.col(metric).alias("o"))
    both = runs.where(F.col("method") != other).join(own, ["run_id", "draw"]).select("run_id", "draw", F.col("method").alias("base"), F.col(metric).alias("b"), "o")
    return _intervals(both.where("b is not null and o is not null"), "base", "run_id")


def _intervals(both: DataFrame, *keys: str) -> DataFrame:
    d = F.col("b") - F.col("o")
    t = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"), F.avg("b").alias("base_mean"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"))
    half = F.when(F.col("n") > 1, t_975(F.col("n") - 1) * F.col("sd") / F.sqrt(F.col("n")))
    gain = F.when(F.col("base_mean") > 0, F.col("mean_diff") / F.col("base_mean"))
    return t.select(*keys, "n", "mean_diff", half.alias("half_width"), gain.alias("relative_gain"), "positive", "negative")


def composite(runs: DataFrame, base: str, other: str, least_gain: float = 0.02, most_rare_loss: float = 0.02, most_brief_loss: float = 0.02, by: tuple[str, ...] = ()) -> DataFrame:
    """gain, the four conditions and the decision on method other against base; runs: run_id, method, brier and the two recalls, a row for each draw.

    The gain is that of the means over runs (each the mean of its draws), relative to base's. In every run other must have
    the smaller error and lose at most so much of the recall of rare features and of brief events. A relative gain over
    zero and a recall that some run doesn't have are unknown, and make the whole not evaluable even beside a failure.
    """
    wide = []
    for p, m in (("b", base), ("o", other)):
        wide += [F.avg(F.when(F.col("method") == m, F.col(c))).alias(f"{p}_{c}") for c in ("brier", "rare_positive_recall", "short_positive_recall")]
    each = runs.groupBy(*by, "run_id").agg(*wide).where("b_brier is not null and o_brier is not null")
    loss = lambda c: F.col(f"b_{c}") - F.col(f"o_{c}")
    every = lambda c: F.when(F.count("*") == F.count(c), F.bool_and(c))
    b = F.avg("b_brier")
    out = each.groupBy(*by, F.lit(0).alias("_")).agg(  # no runs: no row
        F.when(b > 0, (b - F.avg("o_brier")) / b).alias("gain"), F.bool_and(F.col("b_brier") > F.col("o_brier")).alias("every_run_gains"),
        every(loss("rare_positive_recall") <= most_rare_loss).alias("rare_kept"), every(loss("short_positive_recall") <= most_brief_loss).alias("brief_kept"),
    )
    enough = F.col("gain") >= least_gain
    return out.select(*by, "gain", enough.alias("enough_gain"), "every_run_gains", "rare_kept", "brief_kept", decision(enough, F.col("every_run_gains"), F.col("rare_kept"), F.col("brief_kept")).alias("decision"))
