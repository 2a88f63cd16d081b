"""Retrieval quality: set metrics, containment, ROC, score profiles, knob sweeps, latency."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.config import Knobs


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def set_metrics(results: DataFrame, truth: DataFrame, queries: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """precision, recall, f1 and returned per query (and per column of `by`, which queries and results have).

    results and truth: query_id, id.  No result and no truth is a perfect answer; a zero denominator gives zero.
    """
    hits = results.join(truth.withColumn("hit", F.lit(True)), ["query_id", "id"], "left")
    wanted = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    return counted_metrics(hits.withColumnRenamed("hit", "relevant"), wanted, queries, by)


def counted_metrics(results: DataFrame, wanted: DataFrame, queries: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """set_metrics() of results that say whether they are relevant, and wanted(query_id, wanted), the sizes of truths."""
    keys = [*by, "query_id"]
    found = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("returned"), F.count_if("relevant").alias("tp"))
    rows = queries.select(*keys).join(found, keys, "left").join(wanted, "query_id", "left")
    n, tp, w = (F.coalesce(c, F.lit(0)) for c in ("returned", "tp", "wanted"))
    rows = rows.select(*keys, n.alias("returned"), tp.alias("tp"), w.alias("wanted"))
    none = (F.col("returned") == 0) & (F.col("wanted") == 0)
    rows = rows.withColumn("precision", F.when(none, 1.0).otherwise(ratio(F.col("tp"), F.col("returned"))))
    rows = rows.withColumn("recall", F.when(none, 1.0).otherwise(ratio(F.col("tp"), F.col("wanted"))))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).select(*keys, "returned", "precision", "recall", "f1")


def macro(metrics: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    names = ("f1", "precision", "recall", "returned")
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in names])


def overlap(results: DataFrame, pairs: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """pairs(a, b) of queries with the sizes of their result sets and of the intersection (per column of `by`, which
    results and pairs have)."""
    by = list(by)
    sizes = results.groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = (results.select(*by, F.col("query_id").alias(c), "id") for c in ("a", "b"))
    common = pairs.join(a, [*by, "a"]).join(b, [*by, "b", "id"]).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("common"))
    size = lambda c: sizes.select(*by, F.col("query_id").alias(c), F.col("n").alias(f"n_{c}"))
    out = pairs.join(common, [*by, "a", "b"], "left").join(size("a"), [*by, "a"], "left").join(size("b"), [*by, "b"], "left")
    return out.select(*by, "a", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("common", "n_a", "n_b")])


def containment(results: DataFrame, pairs: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """How much of a specific query's results its head query has too; an empty result contains nothing."""
    return overlap(results, pairs, by).select(*by, F.col("a").alias("specific"), F.col("b").alias("head"), ratio(F.col("common"), F.col("n_a")).alias("containment"))


def plural_overlap(results: DataFrame, pairs: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Intersection over the smaller of two result sets; zero if one is empty."""
    return overlap(results, pairs, by).select(*by, "a", "b", ratio(F.col("common"), F.least("n_a", "n_b")).alias("overlap"))


def false_positives(results: DataFrame, distractors: DataFrame) -> DataFrame:
    """How many off-domain queries have any result."""
    hit = distractors.select("query_id").join(results.select("query_id"), "query_id", "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("distractor_fp"))


def hit_rates(ranks: DataFrame, ks: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """ranks: query_id, rank, relevant.  The share of queries with a relevant row among the first k."""
    best = ranks.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"))
    return best.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks])


def outcome_rates(outcomes: DataFrame) -> DataFrame:
    """outcomes: query_id, n_passed, n_fallback.  Shares of queries with no result and of those that fell back."""
    empty = (F.col("n_passed") == 0) & (F.col("n_fallback") == 0)
    return outcomes.agg(F.avg(empty.cast("double")).alias("empty_rate"), F.avg(((F.col("n_passed") == 0) & (F.col("n_fallback") > 0)).cast("double")).alias("fallback_rate"))


def confusion(scores: DataFrame, name: str = "name") -> DataFrame:
    """(expected, predicted, n): each row's best-scoring label against its own."""
    best = scores.groupBy(name, "expected").agg(F.max_by("label", F.struct("score", "label")).alias("predicted"))
    return best.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def diagonal(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


#: Grid that curves and quantiles are taken on: cosines have two million places on it, however many pairs there are.
GRID = 1e-6


def on_grid(value: Column, width: float) -> Column:
    """The nearest place of the grid, divided rather than multiplied, so that decimals stay what they are."""
    return F.round(value / width) / F.lit(float(round(1 / width)))


def binned(scores: DataFrame, width: float = GRID, column: str = "score") -> DataFrame:
    """The column's values on a grid of one part in a whole number."""
    return scores.withColumn(column, on_grid(F.col(column), width))


def tallied(scores: DataFrame, by: str = "relevant", width: float = GRID) -> DataFrame:
    """(by, score, pairs, off, off2) of scores, a row for each place of the grid, as search.tally() counts them; such a
    table stays as it is."""
    if {"pairs", "off", "off2"} <= set(scores.columns):
        return scores
    at = on_grid(F.col("score"), width)
    rows = scores.select(by, at.alias("_at"), (F.col("score") - at).alias("off"))
    return rows.groupBy(by, F.col("_at").alias("score")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("off").alias("off"), F.sum(F.col("off") * F.col("off")).alias("off2"))


def distribution(scores: DataFrame, by: str = "relevant", quantiles: Iterable[float] = (0.1, 0.25, 0.5, 0.75, 0.95), width: float = GRID) -> DataFrame:
    """Count, mean, deviation and quantiles of scores or their tally; the latter between places of the grid, which bounds
    what a task orders."""
    quantiles = list(quantiles)
    every, up = Window.partitionBy(by), Window.partitionBy(by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    rows = tallied(scores, by, width).select(by, "score", "pairs", "off", "off2", F.sum("pairs").over(up).alias("_upto"), F.sum("pairs").over(every).alias("_n"), F.sum(F.col("score") * F.col("pairs") + F.col("off")).over(every).alias("_sum"))
    apart = F.col("score") - F.col("_sum") / F.col("_n")
    at = lambda i: F.max(F.when((F.col("_upto") - F.col("pairs") <= i) & (F.col("_upto") > i), F.col("score")))
    places = [F.lit(x) * (F.col("_n") - 1) for x in quantiles]
    ends = [at(end(p)).alias(f"_{side}{i}") for i, p in enumerate(places) for side, end in (("lo", F.floor), ("hi", F.ceil))]
    out = rows.groupBy(by).agg(F.max("_n").alias("n"), F.max("_sum").alias("_sum"), F.sum(F.col("pairs") * apart * apart + 2 * apart * F.col("off") + F.col("off2")).alias("_squares"), F.max("_n").alias("_n"), *ends)

    def between(i: int, p: Column) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(f"p{round(100 * quantiles[i])}")

    deviation = F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_squares"), F.lit(0.0)) / (F.col("_n") - 1)))
    return out.select(by, "n", (F.col("_sum") / F.col("_n")).alias("mean"), deviation.alias("std"), *[between(i, p) for i, p in enumerate(places)])


def _steps(scores: DataFrame, width: float) -> DataFrame:
    """Positives and negatives at each place of the grid, of scores or their tally, and their sums from the highest score
    down; one task orders the grid's places, not the scores."""
    number = F.col("pairs") if "pairs" in scores.columns else F.lit(1)
    count = lambda which: F.coalesce(F.sum(F.when(which, number)), F.lit(0))
    steps = binned(scores, width).groupBy("score").agg(count(F.col("relevant")).alias("pos"), count(~F.col("relevant")).alias("neg"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("score", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))


def roc_auc(scores: DataFrame, width: float = GRID) -> DataFrame:
    """Chance that a relevant pair outscores another, ties on the grid counting half."""
    s = _steps(scores, width)
    pos, neg, tp = (F.col(c).cast("double") for c in ("pos", "neg", "tp"))  # products can exceed a long
    total = s.agg(F.sum(pos).alias("p"), F.sum(neg).alias("n"), F.sum(pos * neg * 0.5 + neg * (tp - pos)).alias("area"))
    return total.select((F.col("area") / (F.col("p") * F.col("n"))).alias("auc"))


def _rates(scores: DataFrame, width: float) -> DataFrame:
    every = Window.partitionBy()
    s = _steps(scores, width)
    return s.select("score", (F.col("tp") / F.sum("pos").over(every)).alias("tpr"), (F.col("fp") / F.sum("neg").over(every)).alias("fpr"))


def youden(scores: DataFrame, width: float = GRID) -> DataFrame:
    """The cut with the largest tpr - fpr, the highest of equals."""
    return _rates(scores, width).withColumn("j", F.col("tpr") - F.col("fpr")).orderBy(F.desc(F.round("j", 12)), F.desc("score")).limit(1)


def cut_at_tpr(scores: DataFrame, target: float, width: float = GRID) -> DataFrame:
    """The highest cut whose tpr is at least target."""
    return _rates(scores, width).filter(F.col("tpr") >= target).orderBy(F.desc("score")).limit(1)


def best_ratios(ranks: DataFrame, first: int = 20, width: float = GRID) -> DataFrame:
    """score / best over the first ranks of each query, by relevance; the median on the grid."""
    rows = ranks.filter(F.col("rank") <= first).withColumn("r", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    at = on_grid(F.col("r"), width)
    return rows.groupBy("relevant").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_ratio"), F.percentile(at, F.lit(0.5)).alias("median_ratio"))


def knob_grid(thresholds: Iterable[float], ratios: Iterable[float], top_ks: Iterable[int], fallbacks: Iterable[int]) -> list[Knobs]:
    return [Knobs(t, r, k, f) for t in thresholds for r in ratios for k in top_ks for f in fallbacks]


def sweep(scores: DataFrame, grid: list[Knobs]) -> DataFrame:
    """config, query_id, id of what each setting returns, and `relevant` if scores have it.  Scores are ranked once, and where every setting has a top_k only
    ranks that one of them may return are kept; a setting is then a filter on rank, score and best, so the grid multiplies
    those few rows, in one projection."""
    w = Window.partitionBy("query_id")
    ranks = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    if all(k.top_k for k in grid):
        ranks = ranks.filter(F.col("rank") <= max(max(k.top_k, k.fallback) for k in grid))
    base = ranks.withColumn("best", F.max("score").over(w))
    knob = lambda values: F.element_at(F.lit(values), F.col("config") + 1)
    threshold, share = knob([float(k.threshold) for k in grid]), knob([float(k.ratio) for k in grid])
    top_k, fallback = knob([k.top_k or (1 << 31) - 1 for k in grid]), knob([k.fallback for k in grid])
    more = [c for c in scores.columns if c == "relevant"]
    rows = base.select("query_id", "id", *more, "score", "best", "rank", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("config"))
    # the best row passes if any does, so whether a query falls back shows in every row of it
    some = (F.col("best") >= threshold) & (F.col("best") >= F.col("best") * share)
    passes = F.when(some, (F.col("score") >= threshold) & (F.col("rank") <= top_k)).otherwise(F.col("rank") <= fallback)
    return rows.filter((F.col("score") >= F.col("best") * share) & passes).select("config", "query_id", "id", *more)


def objective(per_config: DataFrame) -> DataFrame:
    """The composite score of a setting: f1 + 0.8 sub + 0.6 plural - 0.2 distractor hits; best ten."""
    value = F.col("f1") + 0.8 * F.col("sub") + 0.6 * F.col("plural") - 0.2 * F.col("distractor_fp")
    return per_config.withColumn("objective", value).orderBy(F.desc(F.round("objective", 9)), "config").limit(10)


#: Rows of a key that a latency window's task orders at once, and rows of a part by quantiles at least.
STRETCH, PART_ROWS = 10_000, 20_000


def part_bounds(rows: DataFrame, value: Column, parts: int, part_rows: int | None = None) -> list[float]:
    """Quantiles that cut the rows into `parts`, or into as many as leave part_rows or PART_ROWS each: every row is
    compared with all."""
    found, n = rows.agg(F.percentile_approx(value, F.lit([i / parts for i in range(1, parts)]), F.lit(10_000)), F.count(F.lit(1))).first()
    step = max(1, parts * (part_rows or PART_ROWS) // max(1, n))
    return sorted(set((found or [])[step - 1 :: step])) or [0.0]


def placed(rows: DataFrame, key: str, by: list[str], parts: int = 200, name: str = "nth") -> DataFrame:
    """rows with their place from 0 within their key, in order of `by`, times or numbers first.

    Quantiles of the first column, taken once, deal a key's rows to parts; counts of parts give each its start, so no task
    orders a key whole.  Rows that are equal in that column share a part.
    """
    first = F.col(by[0]).cast("timestamp").cast("double") if dict(rows.dtypes)[by[0]].startswith("timestamp") else F.col(by[0]).cast("double")
    bounds = part_bounds(rows, first, parts)
    part = F.greatest(F.size(F.filter(F.lit(bounds), lambda b: b < first)), F.lit(0))  # a null is first
    # by a generator, so that the part is a column of its own: as an expression, Spark would carry it over the join below to
    # the side that no longer has what it is made of
    rows = rows.select("*", F.inline(F.array(F.struct(part.alias("_part")))))
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_of")) - F.col("_n")  # `parts` rows a key
    starts = counts.select("_key", "_of", before.alias("_start"))
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by)) - 1
    out = rows.withColumn("_local", local).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return out.withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_local", "_key", "_of", "_start", "_n")


def latency(events: DataFrame, *, key: str, ts: str, value: str, last: int = 50, stretch: int = STRETCH) -> DataFrame:
    """Median and 95th percentile of the `last` values up to each event.  A key's events are numbered and cut into
    stretches, each with the events before it that its first windows reach back to, so few keys still make many tasks."""
    rows = placed(events.select("event_id", key, ts, value), key, [ts, "event_id"])
    own, back = F.floor(F.col("nth") / stretch).cast("long"), F.floor((F.col("nth") + last - 1) / stretch).cast("long")
    rows = rows.withColumn("_own", own).withColumn("_in", F.explode(F.sequence("_own", back)))  # `last` is less than a stretch
    w = Window.partitionBy(key, "_in").orderBy("nth").rowsBetween(-(last - 1), 0)
    both = rows.withColumn("_q", F.percentile(value, F.array(F.lit(0.5), F.lit(0.95))).over(w)).filter(F.col("_own") == F.col("_in"))
    return both.select("event_id", key, F.col("_q")[0].alias("p50"), F.col("_q")[1].alias("p95"))


def needs_ann(events: DataFrame, cohort: int, *, rows_over: int = 30_000, p95_over: float = 150.0, days: int = 7, ts: str = "ts", value: str = "value", width: float = 1e-3) -> DataFrame:
    """Whether the last `days` justify an approximate index: a cohort larger than rows_over, and slow at the 95th
    percentile, which is taken on a grid, of milliseconds as a rule."""
    end = events.agg(F.max(ts).alias("end"))
    recent = events.join(F.broadcast(end)).filter(F.col(ts) > F.col("end") - F.expr(f"INTERVAL {days} DAYS"))  # one row
    at = on_grid(F.col(value), width)
    return recent.agg(F.percentile(at, F.lit(0.95)).alias("p95")).select("p95", (F.lit(cohort > rows_over) & (F.col("p95") > p95_over)).alias("migrate"))


def fastest(runs: DataFrame) -> DataFrame:
    """The setting of least elapsed time, the first tried of equals.  runs: threads, elapsed, ord."""
    return runs.agg(F.min_by("threads", F.struct("elapsed", "ord")).alias("threads"), F.min("elapsed").alias("elapsed"))
