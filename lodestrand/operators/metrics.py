"""Retrieval metrics over whole sets of cases, comparison of runs, selection among candidates, gates."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio

#: Metric names by whether more or less of them is better, for the Pareto front.
HIGHER = ("recall", "coverage", "ndcg", "precision")
LOWER = ("mean_target_rank", "chunk_count")


def case_metrics(cases: DataFrame, targets: DataFrame, hits: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each case (and run, if `by` names its columns).

    cases(query_id), targets(query_id, item_id, excluded boolean), hits(by..., query_id, item_id, rank). coverage: found / expected targets; ndcg: sum of
    1 / log2(rank + 1) over found ones / expected ones; precision: relevant hits / k; rr: 1 / first relevant rank. A case passes that
    expects something if it finds some and no excluded one; that only excludes, if it finds none of these; that does neither, if it has a hit.
    """
    top = hits.where(F.col("rank") <= k)
    runs = top.select(*by).distinct() if by else None
    base = cases.select("query_id").crossJoin(F.broadcast(runs)) if runs is not None else cases.select("query_id")  # a row for each run
    own = targets.groupBy("query_id").agg(F.sum(F.when(~F.col("excluded"), 1).otherwise(0)).alias("expected"), F.sum(F.when(F.col("excluded"), 1).otherwise(0)).alias("barred"))
    met = top.join(targets, ["query_id", "item_id"])
    # summed in order of rank: runs that find the same ranks have the same gain to the last bit, whatever the order of rows. Up to k ranks
    ranks = F.array_sort(F.collect_list(F.when(~F.col("excluded"), F.col("rank"))))
    gain = F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    found = met.groupBy(*by, "query_id").agg(
        F.count_distinct(F.when(~F.col("excluded"), F.col("item_id"))).alias("found"), gain.alias("gain"), F.min(F.when(~F.col("excluded"), F.col("rank"))).alias("first_rank"),
        F.sum(F.when(~F.col("excluded"), 1).otherwise(0)).alias("relevant"), F.sum(F.when(F.col("excluded"), 1).otherwise(0)).alias("excluded_hits"),
    )
    size = top.groupBy(*by, "query_id").agg(F.count("*").alias("hits"))
    x = base.join(own, "query_id", "left").join(found, [*by, "query_id"], "left").join(size, [*by, "query_id"], "left")
    x = x.fillna(0, ["expected", "barred", "found", "gain", "relevant", "excluded_hits", "hits"])
    passed = F.when(F.col("expected") > 0, (F.col("found") > 0) & (F.col("excluded_hits") == 0)).when(F.col("barred") > 0, F.col("excluded_hits") == 0).otherwise(F.col("hits") > 0)
    first = F.when(F.col("expected") > 0, F.col("first_rank")).when(F.col("hits") > 0, 1)
    return x.select(*by, "query_id", "expected", "found", ratio(F.col("found"), F.col("expected")).alias("coverage"), ratio(F.col("gain"), F.col("expected")).alias("ndcg"), (F.col("relevant") / F.lit(k)).alias("precision"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"), first.alias("first_rank"), "excluded_hits", passed.alias("passed"))


def summary(metrics: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each run: means over its cases; a case that found nothing has rank k + 1."""
    rank = F.coalesce(F.col("first_rank"), F.lit(k + 1)).cast("double")
    return metrics.groupBy(*by).agg(
        F.count("*").alias("cases"), F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("recall"), ratio(F.sum("found"), F.sum("expected")).alias("coverage"), F.avg("ndcg").alias("ndcg"),
        F.avg("precision").alias("precision"), F.avg("rr").alias("mrr"), F.avg(rank).alias("mean_target_rank"), F.percentile(rank, 0.95).alias("p95_target_rank"), F.sum(F.when(~F.col("passed"), 1).otherwise(0)).alias("failed"),
    )


def retrieval_score() -> Column:
    return F.col("recall") * 0.35 + F.col("coverage") * 0.25 + F.col("ndcg") * 0.25 + F.col("precision") * 0.15


def pairwise(metrics: DataFrame, run: str, k: int) -> DataFrame:
    """Ordered pairs of runs over the same cases: wins, ties and mean differences. A win is by (coverage, ndcg, rr, precision), compared in that order."""
    key = F.struct("coverage", "ndcg", "rr", "precision")
    a = metrics.select("query_id", F.col(run).alias("a"), key.alias("ka"), F.coalesce("first_rank", F.lit(k + 1)).alias("ra"))
    b = metrics.select("query_id", F.col(run).alias("b"), key.alias("kb"), F.coalesce("first_rank", F.lit(k + 1)).alias("rb"))
    both = a.join(b, "query_id").where("a <> b")
    delta = lambda c: F.avg(F.col(f"ka.{c}") - F.col(f"kb.{c}")).alias(f"d_{c}")
    return both.groupBy("a", "b").agg(F.count("*").alias("cases"), F.sum((F.col("ka") > F.col("kb")).cast("int")).alias("wins"), F.sum((F.col("ka") == F.col("kb")).cast("int")).alias("ties"), delta("coverage"), delta("ndcg"), delta("rr"), delta("precision"), F.avg(F.col("ra") - F.col("rb")).alias("d_rank"))


def seed_of(*parts: str) -> int:
    """A number made of names, the same everywhere: code points, each times its place from 1."""
    return sum(i * ord(c) for i, c in enumerate("|".join(parts), 1))


def resampled(values: list[float], seed: int, resamples: int = 1000, confidence: float = 0.95) -> tuple[float, float]:
    """Interval of the mean: resamples of the values, in their order, by the standard library's generator."""
    if len(values) == 1:
        return values[0], values[0]
    draw, n = random.Random(seed).randrange, len(values)
    means = sorted(sum([values[draw(n)] for _ in range(n)]) / n for _ in range(max(1, resamples)))
    tail = max(0.0, min(1.0, 1.0 - confidence)) / 2
    return means[int(tail * (len(means) - 1))], means[int((1.0 - tail) * (len(means) - 1))]


def bootstrap_interval(deltas: DataFrame, by: list[str], value: str, order: str, metric: str, *, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(by..., mean, low, high): interval of each group's mean, seeded by the group's names and the metric's; values in the order of a column. A group is a pair of runs over one set of cases; drawing is sequential by definition, so one task has all of a pair's values, 8 bytes each."""
    names = ", ".join(f"{b} string" for b in by)

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].astype(float).tolist()
        low, high = resampled(x, seed_of(*map(str, key), metric), resamples, confidence)
        return pd.DataFrame([[*map(str, key), sum(x) / len(x), low, high]], columns=[*by, "mean", "low", "high"])

    return deltas.where(F.col(value).isNotNull()).select(*by, value, order).groupBy(*by).applyInPandas(each, f"{names}, mean double, low double, high double")


def pareto(candidates: DataFrame, name: str, higher: tuple[str, ...] = HIGHER, lower: tuple[str, ...] = LOWER) -> DataFrame:
    """The candidates that no other dominates: none is as good in everything and better in something. A missing gain is 0, a missing cost infinite."""
    up = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in higher]
    down = [F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))).alias(c) for c in lower]
    x, y = candidates.select(name, *up, *down).alias("x"), candidates.select(name, *up, *down).alias("y")
    col = lambda t, c: F.col(f"{t}.{c}")
    fair = [col("y", c) >= col("x", c) for c in higher] + [col("y", c) <= col("x", c) for c in lower]
    better = [col("y", c) > col("x", c) for c in higher] + [col("y", c) < col("x", c) for c in lower]
    every, some = fair[0], better[0]
    for c in fair[1:]:
        every = every & c
    for c in better[1:]:
        some = some | c
    return x.join(y, (col("x", name) != col("y", name)) & every & some, "left_anti").select(name)


def selection_score(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.least(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * w
    return total


def long_metrics(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys..., metric, actual) of the named columns."""
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("actual")) for n in names])).alias("m")).select(*keys, "m.metric", "m.actual")


def gate(actuals: DataFrame, thresholds: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Check rows: every threshold (name, metric, operator, threshold) against actuals(keys..., metric, actual). A metric that is missing fails its check."""
    runs = actuals.select(*keys).distinct() if keys else None
    t = F.broadcast(thresholds) if runs is None else runs.crossJoin(F.broadcast(thresholds))  # thresholds are configuration
    x = t.join(actuals, [*keys, "metric"], "left")
    op = F.col("operator")
    ok = F.when(op == ">=", F.col("actual") >= F.col("threshold")).when(op == "<=", F.col("actual") <= F.col("threshold")).when(op == ">", F.col("actual") > F.col("threshold")).when(op == "<", F.col("actual") < F.col("threshold")).otherwise(F.col("actual") == F.col("threshold"))
    return x.select(*keys, "name", "metric", "operator", "actual", "threshold", F.coalesce(ok, F.lit(False)).alias("passed"))


def report(checks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Whether all of a report's checks passed."""
    return checks.groupBy(*keys).agg(F.count("*").alias("checks"), F.sum((~F.col("passed")).cast("int")).alias("failures"), F.min(F.col("passed")).alias("passed"))


def lift(actuals: DataFrame, baseline: str, run: str) -> DataFrame:
    """Difference and ratio of each run's metrics to the baseline run's; the ratio is null where the baseline's is not above 0."""
    base = actuals.where(F.col(run) == baseline).select("metric", F.col("actual").alias("base"))
    return actuals.join(base, "metric").select(run, "metric", "actual", (F.col("actual") - F.col("base")).alias("delta"), F.when(F.col("base") > 0, F.col("actual") / F.col("base")).alias("ratio"))


def greedy_cap(cases: DataFrame, limit: int) -> DataFrame:
    """The cases kept when, in order of ord, one is skipped as soon as any of its targets is in `limit` kept ones. cases(ord, case_id, targets array<string>): sequential by definition, so one task does it, a list of cases at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in batches:
            keep = []
            for row in pdf.itertuples():
                ts = set(row.targets)
                if all(seen.get(t, 0) < limit for t in ts):
                    for t in ts:
                        seen[t] = seen.get(t, 0) + 1
                    keep.append(row.Index)
            yield pdf.loc[keep, ["case_id"]]

    return cases.select("ord", "case_id", "targets").coalesce(1).sortWithinPartitions("ord", "case_id").mapInPandas(run, cases.select("case_id").schema)
