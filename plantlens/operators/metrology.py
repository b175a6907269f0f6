"""Virtual metrology and supervised detection with MLlib boosting, and their measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.tables import materialised


def split_label(ts: Column, train_end: str, valid_end: str) -> Column:
    """train, valid or test by time."""
    return F.when(ts < F.lit(train_end).cast("timestamp_ntz"), "train").when(ts < F.lit(valid_end).cast("timestamp_ntz"), "valid").otherwise("test")


def relative_target(value: Column, nominal: Column, scale: Column | None = None) -> Column:
    """value / nominal - 1, or (value - nominal) / scale."""
    return ratio(value, nominal) - 1 if scale is None else ratio(value - nominal, scale)


def unscaled(target: Column, nominal: Column, scale: Column | None = None) -> Column:
    return (target + 1) * nominal if scale is None else target * scale + nominal


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


def _with_missing(scored: DataFrame, df: DataFrame, features: list[str], into: str) -> DataFrame:
    """Scored rows, and with a null score those that a missing feature (null or NaN) keeps from being scored."""
    missing = reduce(lambda a, b: a | b, [F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in features])
    return scored.unionByName(df.where(missing).withColumn(into, F.lit(None).cast("double")))


def alike(df: DataFrame, features: list[str], target: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of equal features (and keys) as one: their number, the total and the squares of their target, which add up over keys.

    Rows without target are left out. Boosting with squared error takes no more from rows of equal features than these sums.
    """
    y = F.col(target).cast("double")
    return df.where(y.isNotNull()).groupBy(*(keys or []), *features).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_total"), F.sum(y * y).alias("_squares"))


def _boosting(sums: DataFrame, features: list[str], target: str, rounds: int, depth: int, seed: int, into: str):
    """Boosting fitted on a table of `alike` with _valid, in which features may repeat; valid rows stop it.

    Equal features become two rows of half their weight, a standard deviation above and below the mean (one, where there is
    no deviation), so weight, total and squares are those of all rows they stand for: in splits, leaves and validation error.
    Up to 256 bins a feature, as in the reference's histograms; MLlib samples for them beyond 65,536 (256 squared) of these rows.
    """
    from pyspark.ml.regression import GBTRegressor

    x = sums.groupBy("_valid", *features).agg(*[F.sum(c).alias(c) for c in ("_n", "_total", "_squares")])
    x = x.withColumn("_mean", F.col("_total") / F.col("_n"))
    x = x.withColumn("_spread", F.sqrt(F.greatest(F.col("_squares") / F.col("_n") - F.col("_mean") * F.col("_mean"), F.lit(0.0))))
    x = x.withColumn("_sides", F.when(F.col("_spread") > 0, F.array(-F.col("_spread"), F.col("_spread"))).otherwise(F.array(F.lit(0.0))))
    x = x.select("_valid", *features, "_mean", (F.col("_n") / F.size("_sides")).alias("_weight"), F.explode("_sides").alias("_side"))
    x = materialised(x.select("_valid", *features, "_weight", (F.col("_mean") + F.col("_side")).alias(target)), "alike")  # a fit reads it several times
    gbt = GBTRegressor(featuresCol="_features", labelCol=target, weightCol="_weight", predictionCol=into, maxIter=rounds, maxDepth=depth, maxBins=256, seed=seed, validationIndicatorCol="_valid")
    return gbt.fit(_assembled(x, features).select("_features", target, "_weight", "_valid"))


def boosted(df: DataFrame, features: list[str], target: str, split: str, rounds: int = 20, depth: int = 4, seed: int = 7, into: str = "predicted") -> DataFrame:
    """df with a boosted regression's prediction, fit on train rows with early stopping on valid rows; null where a feature is missing."""
    own = df.where(F.col(split).isin("train", "valid")).withColumn("_valid", F.col(split) == "valid")
    fit = _boosting(alike(own, features, target, ["_valid"]), features, target, rounds, depth, seed, into)
    return _with_missing(fit.transform(_assembled(df, features)).drop("_features"), df, features, into)


def classified(df: DataFrame, features: list[str], label: str, split: str, rounds: int = 20, depth: int = 4, seed: int = 7, into: str = "score") -> DataFrame:
    """df with a class-weighted boosted classifier's probability of label 1; null where a feature is missing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    x = _assembled(df, features).withColumns({"_valid": F.col(split) == "valid", "_y": F.col(label).cast("double")})
    own = x.where(F.col(split).isin("train", "valid"))
    share = own.agg(F.avg("_y")).first()[0] or 0.5
    own = own.withColumn("_w", F.when(F.col("_y") == 1, (1 - share) / max(share, 1e-9)).otherwise(1.0))
    gbt = GBTClassifier(featuresCol="_features", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="_valid")
    out = gbt.fit(own.select("_features", "_y", "_w", "_valid")).transform(x)
    out = out.withColumn(into, vector_to_array("probability")[1]).drop("_features", "_valid", "_y", "rawPrediction", "probability", "prediction")
    return _with_missing(out, df, features, into)


def error_measures(df: DataFrame, keys: list[str], order: list[str], measured: str, predicted: str, gauge: Column) -> DataFrame:
    """One row per key: RMSE, RMSE over the gauge's error, R squared, slope of measured on predicted, lag-1 of errors."""
    e = F.col(measured) - F.col(predicted)
    x = df.withColumn("_e", e).withColumn("_b", F.lag("_e").over(Window.partitionBy(*keys).orderBy(*order)))
    pair = F.col("_b").isNotNull()
    a, b = F.when(pair, F.col("_e")), F.when(pair, F.col("_b"))
    out = x.groupBy(*keys).agg(
        F.count("_e").alias("n"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        (1 - F.sum(F.col("_e") * F.col("_e")) / F.nullif(F.var_pop(measured) * F.count("_e"), F.lit(0.0))).alias("r2"),
        (F.covar_pop(measured, predicted) / F.nullif(F.var_pop(predicted), F.lit(0.0))).alias("slope"),
        (F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))).alias("lag1"),
        F.max(gauge).alias("_g"),
    )
    return out.withColumn("rmse_over_gauge", ratio(F.col("rmse"), F.col("_g"))).drop("_g")


def per_unit(df: DataFrame, units: Column, into: str = "unit") -> DataFrame:
    """One row per unit 1..units of each row."""
    return df.withColumn(into, F.explode(F.when(units >= 1, F.sequence(F.lit(1), units)).otherwise(F.array().cast("array<int>"))))


def medians(df: DataFrame, by: list, measures: list[str]) -> DataFrame:
    """Medians of measures by group, such as months, or warm months and others."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.median(m).alias(m) for m in measures])


def rolling_origin(df: DataFrame, period: str, first: str, fit, held_out: bool = False, learn: DataFrame | None = None) -> DataFrame:
    """Rows of each period from `first` on, scored by a model of all rows before the period.

    `fit` takes the past rows and returns a function that scores a DataFrame; with `held_out` it takes the rows before the
    last period of the past and the rows of that one, on which boosting stops. Periods are few; each fit is a Spark job of
    its own, and the scored periods are one union. With `held_out` a period needs two before it. `learn` is what fits get in
    place of df's rows, such as their sums by period, made once for all origins.
    """
    rows = df if learn is None else learn
    every = sorted(r[0] for r in df.select(period).distinct().collect() if r[0] is not None)
    out, edge = None, lambda at: F.lit(str(at)).cast("timestamp_ntz")
    for k, at in enumerate(every):
        if str(at) < first or held_out and k < 2:
            continue
        past = rows.where(F.col(period) < edge(every[k - 1] if held_out else at))
        model = fit(past, rows.where(F.col(period) == edge(every[k - 1]))) if held_out else fit(past)
        now = model(df.where(F.col(period) == edge(at)))
        out = now if out is None else out.unionByName(now)
    return df.limit(0) if out is None else out


def boosted_model(train: DataFrame, valid: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 4, seed: int = 7, into: str = "predicted", summed: bool = False):
    """A function that scores a DataFrame by boosting fitted on `train`, stopped by `valid`; null where a feature is missing.

    With `summed`, train and valid are tables of `alike`.
    """
    train, valid = (x if summed else alike(x, features, target) for x in (train, valid))
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    model = _boosting(both, features, target, rounds, depth, seed, into)
    return lambda df: _with_missing(model.transform(_assembled(df, features)).drop("_features"), df, features, into)


def rolling_forest(df: DataFrame, cell: str, period: str, first: str, row_id: str, features: list[str], good: Column, series: list[str], order: list[str], rate: float = 0.003, least: int = 1000, **options) -> DataFrame:
    """Rows of each period from `first` on with the anomaly score, threshold and alarm of a forest of their cell and period.

    A forest and its threshold see the good rows of all periods before alone: rows are dealt to every later origin once,
    and all cells and origins are fitted and scored as groups of one forest table. The threshold is that at which two of
    the last ten scores over it cover `rate` of the rows the forest was fitted on. Cells with fewer than `least` such rows
    have null scores. Nulls count as 0 in scores; null periods are left out.
    """
    from .anomaly import fit_forest, score_forest
    from .evaluate import kth_of_last, order_statistic_threshold

    start = F.lit(first).cast("timestamp_ntz")
    origins = df.where(F.col(period) >= start).select(F.col(period).alias("origin")).distinct()
    own = df.where(F.col(period).isNotNull()).withColumn("_group", F.concat_ws("|", F.col(cell).cast("string"), F.col(period).cast("string")))
    past = df.where(good & F.col(period).isNotNull()).join(F.broadcast(origins), F.col(period) < F.col("origin"))  # a row a month
    past = past.withColumn("_group", F.concat_ws("|", F.col(cell).cast("string"), F.col("origin").cast("string"))).drop("origin")
    enough = past.groupBy("_group").agg(F.count(F.lit(1)).alias("n_fit")).where(F.col("n_fit") >= least)
    past = materialised(past.join(enough.select("_group"), "_group", "left_semi"), "past")
    forest = materialised(fit_forest(past, "_group", row_id, features, **options), "forest")
    seen = score_forest(past, forest, "_group", features)
    limits = order_statistic_threshold(seen, ["_group", *series], order, "anomaly", rate, by=["_group"]).drop("n")
    now = materialised(score_forest(own.where(F.col(period) >= start), forest, "_group", features), "scored")
    now = kth_of_last(now, series, order, "anomaly").join(limits, "_group", "left").join(enough, "_group", "left")
    return now.withColumn("alarm", F.coalesce(F.col("kth") > F.col("threshold"), F.lit(False))).drop("_group", "kth")
