"""Tables of what a plant's screens and reports state: status of runs, capability of runs, reviews, early periods, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, truncated
from .capability import D2, by_size
from .deviation import outside
from .metrology import unscaled


def figures(measures: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(name, value): headline figures, one aggregate a table; as many rows as measures."""
    by_table: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, measure) in measures.items():
        by_table.setdefault(id(df), (df, []))[1].append((name, measure))
    out = None
    for df, own in by_table.values():
        one = df.agg(*[m.cast("double").alias(f"_{k}") for k, (_, m) in enumerate(own)])
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{k}").alias("value")) for k, (name, _) in enumerate(own)])).alias("_x")).select("_x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def pareto_by_period(df: DataFrame, label: Column, ts: str, weight: Column, weeks: list[int]) -> DataFrame:
    """Counts by label over the last weeks of the table (0: all of it), largest first, with cumulative share, for each period."""
    last = df.agg(F.max(ts).alias("_last"))
    # One row is joined; a row counts in every period that it lies in.
    x = df.crossJoin(F.broadcast(last)).withColumn("weeks", F.explode(F.array(*map(F.lit, weeks))))
    x = x.where((F.col("weeks") == 0) | (F.col(ts) >= F.col("_last") - F.make_dt_interval(days=F.col("weeks") * 7)))
    n = x.groupBy("weeks", label.alias("label")).agg(F.sum(weight).alias("n"))
    w = Window.partitionBy("weeks").orderBy(F.desc("n"), "label")
    return n.withColumns({"rank": F.row_number().over(w), "cumulative": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy("weeks"))})


def run_cpk(pieces: DataFrame, keys: list[str], audit: str, value: str, low: Column, high: Column, ts: str, least: int = 8, minimum: float = 1.33) -> DataFrame:
    """Cpk of each run from the spread within its audits, where at least `least` audits have two pieces; and whether it is too low."""
    g = pieces.groupBy(*keys, audit).agg(F.count(value).alias("_n"), (F.max(value) - F.min(value)).alias("_r"), F.sum(value).alias("_s"), F.min(ts).alias("_t"), F.max(low).alias("_low"), F.max(high).alias("_high"))
    many = F.col("_n") > 1
    x = g.groupBy(*keys).agg(F.min("_t").alias("starts"), F.sum("_n").alias("n"), F.count_if(many).alias("audits"), (F.sum("_s") / F.sum("_n")).alias("mean"), F.avg(F.when(many, F.col("_r") / by_size(D2, F.col("_n")))).alias("sigma_within"), F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    near = F.least(F.col("_high") - F.col("mean"), F.col("mean") - F.col("_low"))
    x = x.where(F.col("audits") >= least).withColumn("cpk", ratio(near, 3 * F.col("sigma_within")))
    return x.withColumn("below", F.col("cpk") < minimum).drop("_low", "_high")


def ppk_comparison(audits: DataFrame, predictions: DataFrame, errors: DataFrame, keys: list[str], cell: list[str], value: str, predicted: str, low: Column, high: Column, least: int = 30) -> DataFrame:
    """Ppk of each run from its audits, from the prediction on every piece, and from the prediction widened by the model's error.

    `errors`: cell, rmse, gauge_sd; the error's variance is what the gauge doesn't explain. Runs with fewer than `least`
    audited pieces are left out.
    """
    a = audits.groupBy(*keys, *cell).agg(F.count(value).alias("audit_n"), F.avg(value).alias("_am"), F.stddev_samp(value).alias("sd_audit"), F.max(low).alias("_low"), F.max(high).alias("_high")).where(F.col("audit_n") >= least)
    p = predictions.groupBy(*keys).agg(F.count(predicted).alias("pieces"), F.avg(predicted).alias("_pm"), F.stddev_samp(predicted).alias("sd_predicted"))
    x = a.join(p, keys).join(errors, cell)
    left = F.greatest(F.col("rmse") * F.col("rmse") - F.col("gauge_sd") * F.col("gauge_sd"), F.lit(0.0))
    x = x.withColumn("sd_corrected", F.sqrt(F.col("sd_predicted") * F.col("sd_predicted") + left))
    ppk = lambda mean, sd: ratio(F.least(F.col("_high") - F.col(mean), F.col(mean) - F.col("_low")), 3 * F.col(sd))
    return x.withColumns({"ppk_audit": ppk("_am", "sd_audit"), "ppk_predicted": ppk("_pm", "sd_predicted"), "ppk_corrected": ppk("_pm", "sd_corrected")}).drop("_am", "_pm", "_low", "_high")


def reviews(sorts: DataFrame, shots: DataFrame) -> DataFrame:
    """Reject-bin reviews with the cycle of their shot where they have one, and the share found good."""
    x = sorts.join(shots.select("shot_id", "cycle_no"), "shot_id", "left")
    return x.withColumn("good_share", ratio(F.col("pieces_good").cast("double"), F.col("pieces_reviewed")))


def daily_alarms(alarms: DataFrame, ts: str, values: str, default: str = "match score", separator: str = ";") -> DataFrame:
    """One row a day: rows with an alarm and the commonest value that raised one (ties: the first by name)."""
    x = alarms.select(truncated("day", F.col(ts)).alias("day_ts"), F.coalesce(F.nullif(F.col(values), F.lit("")), F.lit(default)).alias("_v"))
    n = x.groupBy("day_ts").agg(F.count(F.lit(1)).alias("n"))
    each = x.select("day_ts", F.explode(F.split("_v", separator)).alias("value")).groupBy("day_ts", "value").agg(F.count(F.lit(1)).alias("_n"))
    most = each.groupBy("day_ts").agg(F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("mostly"))
    return n.join(most, "day_ts")


def band_positions(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Long form (ids, metric, value, position, percent): where each value stands within its bands."""
    def one(v: str) -> Column:
        col = lambda b: F.col(f"{v}_{b}")
        x = F.col(v)
        at = F.when(outside(x, col("alarm_low"), col("alarm_high")), "ALARM").when(outside(x, col("warning_low"), col("warning_high")), "WARN").when(x.isNotNull(), "OK")
        share = ratio(x - col("alarm_low"), col("alarm_high") - col("alarm_low")) * 100
        return F.struct(F.lit(v).alias("metric"), x.cast("double").alias("value"), at.alias("position"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)).alias("percent"))

    return df.select(*ids, F.explode(F.array(*map(one, values))).alias("_x")).select(*ids, "_x.*").where("value is not null")


def sensors_by(df: DataFrame, key: str, cavity: str, position: str) -> DataFrame:
    """One row per key: its sensed cavities and their positions, as text in order."""
    one = F.struct(F.col(cavity).alias("c"), F.col(position).alias("p"))
    text = F.transform(F.array_sort(F.collect_set(one)), lambda s: F.concat(F.lit("cavity "), s["c"].cast("string"), F.lit(" "), F.replace(s["p"], F.lit("_"), F.lit("-"))))
    return df.groupBy(key).agg(F.array_join(text, ", ").alias("sensors"), F.count_distinct(cavity).alias("sensed_cavities"))


def monthly_rate(df: DataFrame, ts: str, bad: Column) -> DataFrame:
    x = df.groupBy(truncated("month", F.col(ts)).alias("month_ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"))
    return x.withColumn("rate", F.col("n_bad") / F.col("n"))


def worst_groups(df: DataFrame, keys: list[str], cause: str, context: DataFrame, n: int = 3, causes: int = 2) -> DataFrame:
    """The n keys with most rows, their commonest causes with counts as text, and context by key."""
    counts = df.groupBy(*keys, cause).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), cause)))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= causes, F.struct("_r", F.concat_ws(" ", cause, F.col("_n").cast("string")).alias("t"))))), lambda x: x["t"])
    top = ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), F.array_join(text, ", ").alias("causes")).orderBy(F.desc("n"), *keys).limit(n)
    return top.join(context, keys, "left")


def share_within(df: DataFrame, ids: DataFrame, key: str, confirmed: Column) -> DataFrame:
    """One row: of all rows and of the confirmed ones, how many have their key among ids, and the shares."""
    x = df.join(ids.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("_in").alias("n_in"), F.count_if(confirmed).alias("n_confirmed"), F.count_if(confirmed & F.col("_in").isNotNull()).alias("n_confirmed_in")
    )
    return x.withColumns({"share": ratio(F.col("n_in").cast("double"), F.col("n")), "share_confirmed": ratio(F.col("n_confirmed_in").cast("double"), F.col("n_confirmed"))})


def live_status(shots: DataFrame, keys: list[str], order: list[str], state: str, retained: Column, unusual: Column, open_signal: Column, request: Column, keep: list[str]) -> DataFrame:
    """One row per run from its last retained shot: status (an unusual shot overrides OK), open signals, audit asked for, counts so far."""
    x = shots.withColumns({"_retained": retained, "_unusual": F.coalesce(unusual, F.lit(False)), "_open": F.coalesce(open_signal, F.lit(False)), "_request": F.coalesce(request, F.lit(False))})
    last = F.max_by(F.struct(*order, state, "_unusual", "_open", "_request", *[c for c in keep if c not in order]), F.when(F.col("_retained"), F.struct(*order)))
    counts = {f"n_{k}": F.count_if(F.col(state) == k) for k in ("warning", "alarm")}
    out = x.groupBy(*keys).agg(last.alias("_x"), *[c.alias(k) for k, c in counts.items()], F.count_if("_request").alias("n_requests")).where("_x is not null")
    s = F.col(f"_x.{state}")
    status = F.when(s == "alarm", "ALARM").when(s == "warning", "WARNING").when(F.col("_x._unusual"), "UNUSUAL").otherwise("OK")
    return out.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in dict.fromkeys([*order, *keep])], status.alias("status"), F.col("_x._open").alias("open_signal"), F.col("_x._request").alias("audit_requested"), *counts, "n_requests")


def predicted_trace(shots: DataFrame, predictions: DataFrame, audits: DataFrame, key: str, nominal: Column, tolerance: Column, predicted: str, measured: str) -> DataFrame:
    """Shots with the mean predicted dimension of their cavities, un-scaled, and the mean gauged one where a piece was audited."""
    p = predictions.groupBy(key).agg(F.avg(predicted).alias("_p"), F.max(F.abs(F.col(predicted))).alias("largest"))
    a = audits.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(measured).alias("measured"))
    return shots.join(p, key).join(a, key, "left").withColumn("predicted", unscaled(F.col("_p"), nominal, tolerance)).drop("_p")


def templates_wide(long: DataFrame, keys: list[str], metric: str, metrics: list[str], statistics: list[str], reference: DataFrame | None = None, reference_key: str | None = None) -> DataFrame:
    """One row per template from rows (template, metric, statistics): columns `{metric}_{statistic}`, and the template's reference shot."""
    x = long.groupBy(*keys).pivot(metric, metrics).agg(*[F.round(F.first(s, ignorenulls=True), 4).alias(s) for s in statistics])
    return x if reference is None else x.join(reference, reference_key, "left")


def agreement(df: DataFrame, one: str, other: str) -> Column:
    """Share of rows in which two columns are equal; rows where either is null count as unequal."""
    return F.avg(F.coalesce(F.col(one) == F.col(other), F.lit(False)).cast("int"))


def convergence(df: DataFrame, keys: list[str], order: list[str], value: str, tolerance: float) -> DataFrame:
    """One row per run: how many rows come before the first within the tolerance; 0 if none is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_at", F.row_number().over(w) - 1)
    return x.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.abs(F.col(value)) < tolerance, F.col("_at"))), F.lit(0)).alias("rows_before"))


def state_steps(df: DataFrame, keys: list[str], state: Column, value: str) -> DataFrame:
    """One row per run that has both: the median of a value while the state holds over that without, less 1."""
    x = df.withColumn("_s", state).groupBy(*keys).agg(F.median(F.when(F.col("_s"), F.col(value))).alias("_on"), F.median(F.when(~F.col("_s"), F.col(value))).alias("_off"))
    return x.where("_on is not null and _off is not null").select(*keys, (ratio(F.col("_on"), F.col("_off")) - 1).alias("step"))


def curve_shapes(curves: DataFrame, keys: list[str], t: str, value: str, arrival: float, held: float, hold: float) -> DataFrame:
    """One row per curve: arrival, peak and its time, the last time the level is held, and whether it is held past the peak."""
    v = F.col(value)
    x = curves.groupBy(*keys).agg(F.min(F.when(v > arrival, F.col(t))).alias("arrive"), F.max(v).alias("peak"), F.max_by(t, F.struct(v, -F.col(t))).alias("peak_at"), F.max(F.when(v > held, F.col(t))).alias("last_held"))
    return x.withColumn("held_after_peak", F.coalesce(F.col("last_held") > F.col("peak_at") + hold, F.lit(False)))
