"""Detection against chance: budgets, detected above chance, incremental layers, look-back credit, ranking measures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .quantiles import grouped_quantiles, order_statistics
from .windows import START


def alarm_budget(episodes: DataFrame, df: DataFrame, hours: Column, flag: str, shift_hours: int = 8) -> DataFrame:
    """One row: flagged share, shifts (distinct hours over eight), episodes per shift."""
    all_ = df.agg(F.avg(F.col(flag).cast("double")).alias("flagged_share"), (F.count_distinct(hours) / shift_hours).alias("shifts"))
    n = episodes.agg(F.sum(F.col("starts").cast("int")).alias("episodes"))
    return all_.crossJoin(n).withColumn("per_shift", F.col("episodes") / F.col("shifts"))  # one row each


def rates(df: DataFrame, by: list[str], flag: str, bad: str) -> DataFrame:
    """Flag rates among bad and good rows, and their difference."""
    f, d = F.col(flag).cast("int"), F.col(bad).cast("int")
    x = df.groupBy(*by).agg(F.sum(f * d).alias("flagged_bad"), F.sum(d).alias("n_bad"), F.sum(f * (1 - d)).alias("flagged_good"), F.sum(1 - d).alias("n_good"))
    p, q = (F.col(f"flagged_{k}") / F.greatest(F.col(f"n_{k}"), F.lit(1)) for k in ("bad", "good"))
    return x.withColumns({"rate_bad": p, "rate_good": q, "above_chance": p - q})


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and parts, the same on every engine."""
    named = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Where the distribution function of a Poisson(1) count passes 0, 1, 2, ... (a count over 11 has chance 1e-9).
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def poisson_weight(unit: Column, replicate: Column, seed: int) -> Column:
    """A Poisson(1) draw from a hash of the unit and the replicate."""
    passed = lambda u: sum(((u >= c).cast("int") for c in POISSON[1:]), (u >= POISSON[0]).cast("int"))
    return F.get(F.transform(F.array(uniform(seed, unit, replicate)), passed), F.lit(0))


def poisson_weights(units: list[str], replicates: int, seed: int) -> np.ndarray:
    """poisson_weight of every unit in replicates 1, 2, ...: replicates by units, hashed many at a time."""
    out = np.empty((replicates, len(units)), "uint8")
    passed = [math.ceil(c * 4294967296) for c in POISSON]
    heads = [f"{seed}:{u}:".encode() for u in units]
    sizes = np.array([len(h) for h in heads], "int64")
    ends = [str(r).encode() for r in range(1, replicates + 1)]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for digits in sorted({len(e) for e in ends}):
            own = [k for k, e in enumerate(ends) if len(e) == digits]
            if size + digits > 55:  # more than one block of MD5
                drawn = [[int(hashlib.md5(heads[i] + ends[k]).hexdigest()[:8], 16) for i in at] for k in own]
                out[np.ix_(own, at)] = sum((np.array(drawn, "int64") >= c).astype("uint8") for c in passed)
                continue
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                left = np.zeros((len(some), 64), "uint8")
                left[:, :size] = np.frombuffer(b"".join(heads[j] for j in some), "uint8").reshape(len(some), size)
                step = max(1, 32768 // len(some))
                for k in range(0, len(own), step):
                    right = np.zeros((len(own[k : k + step]), 64), "uint8")
                    right[:, size : size + digits] = np.frombuffer(b"".join(ends[j] for j in own[k : k + step]), "uint8").reshape(-1, digits)
                    right[:, size + digits] = 0x80
                    right[:, 56:58] = np.array([8 * (size + digits)], "<u2").view("uint8")
                    hashed = _md5_heads(left.view("<u4").T, right.view("<u4").T)
                    w = np.zeros(hashed.shape, "uint8")
                    for c in passed:
                        w += hashed >= np.uint32(c)
                    out[np.ix_(own[k : k + step], some)] = w
    return out


#: Fixed values of MD5 (RFC 1321): rotations and constants of its 64 steps, and the state that it starts from.
ROTATED = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
ADDED = [int(abs(math.sin(k + 1)) * 4294967296) for k in range(64)]
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_heads(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """First four bytes, as a number, of the MD5 of one block each: right by left, whose 16 words (rows) are added up."""
    shape = (right.shape[1], left.shape[1])
    words = [np.ascontiguousarray(p)[None, :] | q[:, None] if p.any() and q.any() else np.ascontiguousarray(p)[None, :] if p.any() else q[:, None] if q.any() else None for p, q in zip(left, right, strict=True)]
    a, b, c, d = (np.full(shape, v, "uint32") for v in BEGIN)
    f, high = np.empty(shape, "uint32"), np.empty(shape, "uint32")
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            word = k
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            word = (5 * k + 1) % 16
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            word = (3 * k + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            word = 7 * k % 16
        f += a
        f += np.uint32(ADDED[k])
        if words[word] is not None:
            f += words[word]
        np.right_shift(f, np.uint32(32 - ROTATED[k]), out=high)
        f <<= np.uint32(ROTATED[k])
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(BEGIN[0])
    return a.byteswap()


def median_interval(df: DataFrame, keys: list[str], unit: str, value: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """One row per key: the median of a value and the 2.5 and 97.5 % points of its medians over resampled rows.

    For values of events, which are few a key: a replicate costs a row an event. Null values are left out.
    """
    own = df.where(F.col(value).isNotNull()).select(*keys, unit, value)
    w = poisson_weight(F.col(unit), F.col("replicate"), seed)
    drawn = own.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", w).where("_w > 0")
    one = drawn.groupBy(*keys, "replicate").agg(F.percentile(value, F.lit(0.5), F.col("_w")).alias("_m"))
    ends = one.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return own.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n")).join(ends, keys)


def bootstrap_interval(df: DataFrame, cluster: str, flag: str, bad: str, replicates: int = 400, seed: int = 7) -> DataFrame:
    """One row: the rates of one flag with intervals over resampled clusters; see rates_with_intervals."""
    return rates_with_intervals(df, [], cluster, [flag], {"all": F.lit(True)}, bad, replicates, seed).drop("layer", "target")


def rates_with_intervals(df: DataFrame, by: list[str], cluster: str, layers: list[str], targets: dict[str, Column], bad: str, replicates: int = 400, seed: int = 7) -> DataFrame:
    """rates_by_target with 2.5 and 97.5 % points of all three rates over resampled clusters.

    A cluster's weight in a replicate is Poisson(1) from a hash of both, which any task computes alike; replicate 0 holds
    the plain sums. Rows go to the task of their cluster as one number of flags; a task draws its clusters' weights a batch
    at a time and adds them up for all replicates, layers and targets, so that it gives a row a group and replicate.
    Clusters share a weight between groups of `by`.
    """
    sums, rows = _target_sums(layers, targets, bad)
    on = lambda c: F.coalesce(c, F.lit(False))
    flags = [on(~F.col(bad)), on(F.col(bad)), *[on(F.col(c)) for c in layers], *[on(c) for c in targets.values()]]
    packed = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, f in enumerate(flags[i : i + BITS])]).alias(f"_f{i // BITS}") for i in range(0, len(flags), BITS)]
    own = df.select(*by, F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_unit"), *packed).repartition("_unit").sortWithinPartitions("_unit")
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), "replicate int", *(f"{c} long" for c in sums)])
    n, m, size, names = len(layers), len(targets), len(flags), list(sums)
    column = {c: i for i, c in enumerate(names)}

    def counted(f: np.ndarray) -> np.ndarray:
        """Rows by sums: 1 where a row counts in a sum."""
        good, of_bad, layer, target = f[:, :1], f[:, 1:2], f[:, 2 : 2 + n], f[:, 2 + n :] & f[:, 1:2]
        out = np.zeros((len(f), len(names)))
        out[:, column["_good"]] = good[:, 0]
        for i in range(n):
            out[:, column[f"_g{i}"]] = layer[:, i] & good[:, 0]
            for j in range(m):
                out[:, column[f"_b{i}_{j}"]] = layer[:, i] & target[:, j]
        for j in range(m):
            out[:, column[f"_n{j}"]] = target[:, j]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}

        def drained() -> pd.DataFrame:
            parts = [pd.DataFrame(v.astype("int64"), columns=names).assign(replicate=np.arange(replicates + 1, dtype="int32"), **dict(zip(by, k, strict=True))) for k, v in totals.items()]
            totals.clear()
            return pd.concat(parts)[[*by, "replicate", *names]]

        for batch in batches:
            f = np.hstack([(batch[f"_f{i // BITS}"].to_numpy()[:, None] >> np.arange(min(BITS, size - i))) & 1 for i in range(0, size, BITS)]).astype(bool)
            code, units = pd.factorize(batch["_unit"])
            weights = np.vstack([np.ones((1, len(units)), "uint8"), poisson_weights(list(units), replicates, seed)])
            groups = batch.groupby(by, dropna=False).indices if by else {(): np.arange(len(batch))}
            for key, at in groups.items():
                starts = np.flatnonzero(np.diff(code[at], prepend=-1))  # rows are in order of their unit
                x = np.add.reduceat(counted(f[at]), starts)
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                totals[key] = totals.get(key, 0) + weights[:, code[at][starts]].astype("float64") @ x
            if len(totals) > 64:
                yield drained()
        if totals:
            yield drained()

    total = own.mapInPandas(run, schema).groupBy(*by, "replicate").agg(*[F.sum(k).alias(k) for k in sums])
    long = _rates(total.select(*by, "replicate", F.explode(F.array(*rows)).alias("_x")).select(*by, "replicate", "_x.*"))
    own = F.col("replicate") == 0
    first = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    ends = [F.percentile(F.when(~own, F.col(c)), F.lit(q)).alias(f"{c}_{end}") for c in RATES for q, end in ((0.025, "low"), (0.975, "high"))]
    return long.groupBy(*by, "layer", "target").agg(*[first(c) for c in ("flagged_bad", "n_bad", "flagged_good", "n_good", *RATES)], *ends)


#: Flags that one long holds.
BITS = 60
RATES = ("rate_bad", "rate_good", "above_chance")


def _target_sums(layers: list[str], targets: dict[str, Column], bad: str) -> tuple[dict[str, Column], list[Column]]:
    """Aggregates of all layers and targets, and a struct a layer and target that picks its own."""
    d = F.col(bad)
    sums = {"_good": F.count_if(~d)}
    for i, layer in enumerate(layers):
        f = F.coalesce(F.col(layer), F.lit(False))
        sums[f"_g{i}"] = F.count_if(f & ~d)
        for j, condition in enumerate(targets.values()):
            sums[f"_b{i}_{j}"] = F.count_if(f & d & F.coalesce(condition, F.lit(False)))
    for j, condition in enumerate(targets.values()):
        sums[f"_n{j}"] = F.count_if(d & F.coalesce(condition, F.lit(False)))
    rows = [
        F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("target"), F.col(f"_b{i}_{j}").alias("flagged_bad"), F.col(f"_n{j}").alias("n_bad"), F.col(f"_g{i}").alias("flagged_good"), F.col("_good").alias("n_good"))
        for i, layer in enumerate(layers)
        for j, name in enumerate(targets)
    ]
    return sums, rows


def _rates(df: DataFrame) -> DataFrame:
    p, q = (F.col(f"flagged_{k}") / F.greatest(F.col(f"n_{k}"), F.lit(1)) for k in ("bad", "good"))
    return df.withColumns({"rate_bad": p, "rate_good": q, "above_chance": p - q})


def layer_flags(shots: DataFrame, flagged: DataFrame, predictions: DataFrame, key: str, predicted: str, limit: float = 0.75) -> DataFrame:
    """Shots with a flag a layer: template_sort, rules, drift as the shot has them, anomaly by id, virtual_metrology by the largest prediction.

    shots: key, unit_alarm_state, we1, we2, drift_any_signal; flagged: ids; predictions: a row a shot and cavity.
    """
    ids = flagged.select(key).distinct().withColumn("_flagged", F.lit(True))
    most = predictions.groupBy(key).agg(F.max(F.abs(F.col(predicted))).alias("_most"))
    on = lambda c: F.coalesce(c, F.lit(False))
    x = shots.join(ids, key, "left").join(most, key, "left")
    flags = {
        "template_sort": on(F.col("unit_alarm_state") == "alarm"),
        "rules": on(F.col("we1")) | on(F.col("we2")),
        "drift": on(F.col("drift_any_signal")),
        "anomaly": on(F.col("_flagged")),
        "virtual_metrology": on(F.col("_most") > limit),
    }
    return x.withColumns(flags).drop("_flagged", "_most")


def validated(after_approval: Column, position: Column, state: Column, confirmed: Column, rejects: Column, settled: int = 500) -> Column:
    """Whether a shot is known good: settled production, no alarm, and nothing found in sort or audit."""
    nothing = (F.coalesce(confirmed, F.lit(0)) == 0) & (F.coalesce(rejects, F.lit(0)) == 0)
    return F.coalesce(after_approval & (position >= settled) & (state == "none") & nothing, F.lit(False))


def rates_by_target(df: DataFrame, by: list[str], layers: list[str], targets: dict[str, Column], bad: str) -> DataFrame:
    """Rates of each layer for each target: among the bad rows that the target's condition holds for, and among all good rows.

    One aggregate over the table; the long form has a row a group, layer and target.
    """
    sums, rows = _target_sums(layers, targets, bad)
    x = df.groupBy(*by).agg(*[c.alias(k) for k, c in sums.items()])
    return _rates(x.select(*by, F.explode(F.array(*rows)).alias("_x")).select(*by, "_x.*"))


def coverage_and_chance(credited: DataFrame, qty: str, good: DataFrame, good_id: list[str], alarms: DataFrame, key: str, hour: str, layers: dict[str, int], without: tuple[str, ...] = ("virtual_metrology",)) -> DataFrame:
    """One row: share of the defects' quantity that a layer is credited with, and the share of good pieces that any layer would be.

    `credited`: defects with `credited` (see lookback_credit); good pieces have an id, key and hour. Layers named in
    `without` say nothing of a good piece's hour (metrology is of a single cavity) and are left out of the chance.
    """
    d = credited.agg(ratio(F.sum(F.when(F.col("credited").isNotNull(), F.col(qty)).otherwise(0)).cast("double"), F.sum(qty)).alias("detected"), F.sum(qty).cast("double").alias("n_defects"))
    g = lookback_credit(good.select(*good_id, key, hour), alarms, key, hour, {k: v for k, v in layers.items() if k not in without})
    g = g.agg(F.avg(F.col("credited").isNotNull().cast("int")).alias("chance"), F.count(F.lit(1)).alias("n_good"))
    return d.crossJoin(g)  # one row each


def incremental(df: DataFrame, flags: list[str]) -> DataFrame:
    """Flags of layers in order that no earlier layer raised, as `{flag}_only`."""
    earlier, out = F.lit(False), {}
    for f in flags:
        out[f"{f}_only"] = F.col(f) & ~earlier
        earlier = earlier | F.col(f)
    return df.withColumns(out)


def lookback_credit(defects: DataFrame, alarms: DataFrame, key: str, hour: str, layers: dict[str, int], only: dict[str, Column] | None = None) -> DataFrame:
    """Each defect with the layer whose alarm lies furthest back within its look-back (hours); ties go to the earlier layer.

    `only`: for a layer, the condition on defects that it can be credited with (metrology: dimensional ones). `alarms` has key, hour (a number) and layer; `defects` an id, key and hour. A defect meets one row per hour it looks back.
    """
    order = {name: k for k, name in enumerate(layers)}
    most = max(layers.values())
    hours = defects.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("_hour", F.col(hour) - F.col("_back"))
    seen = alarms.select(F.col(key).alias("_key"), F.col(hour).alias("_at"), "layer").distinct()
    met = hours.join(seen, (F.col(key) == F.col("_key")) & (F.col("_hour") == F.col("_at")))
    reach, rank = F.lit(-1), F.lit(len(order))
    for name, back in layers.items():
        reach = F.when(F.col("layer") == name, back).otherwise(reach)
        rank = F.when(F.col("layer") == name, order[name]).otherwise(rank)
    allowed = F.lit(True)
    for name, condition in (only or {}).items():
        allowed = allowed & ((F.col("layer") != name) | condition)
    met = met.where((F.col("_back") <= reach) & allowed)
    best = met.groupBy(*defects.columns).agg(F.max_by("layer", F.struct(F.col("_back"), -rank)).alias("credited"), F.max("_back").alias("hours_back"))
    return defects.join(best, defects.columns, "left")


def kth_largest(df: DataFrame, score: str, k: int) -> tuple[float, int]:
    """(the k-th largest score, how many scores are larger), exactly, by counts of ranges; one row reaches the driver."""
    x = df.where(F.col(score).isNotNull()).select(F.lit(0).alias("_all"), F.col(score).cast("double").alias("_v"))
    n = x.count()
    if n < k:
        raise ValueError(f"there are no {k} scores")
    wanted = df.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n - k + 1).cast("long").alias("rank"))
    edge = order_statistics(x, ["_all"], wanted).first()["_value"]
    return edge, x.where(F.col("_v") > edge).count()


def recall_at_rate(df: DataFrame, score: str, bad: str, tie: str, rate: float) -> DataFrame:
    """One row: how many of the bad rows are among the round(rate * n) highest scores; rows without a score come last."""
    n = df.agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * rate)).cast("int")).first()[0]
    s = F.coalesce(F.col(score), F.lit(float("-inf")))
    df = df.withColumn("_score", s)
    edge, larger = kth_largest(df, "_score", n)
    # Only ties at the edge are ordered.
    at_edge = df.where(F.col("_score") == edge).orderBy(tie).limit(n - larger)
    d = F.sum(F.col(bad).cast("int"))
    top = df.where(F.col("_score") > edge).unionByName(at_edge).agg(d.alias("captured"), F.count(F.lit(1)).alias("k"))
    return df.agg(d.alias("positives")).crossJoin(top).withColumn("recall", ratio(F.col("captured").cast("double"), F.col("positives")))  # one row each


def average_precision(df: DataFrame, score: str, bad: str) -> DataFrame:
    """One row: area under precision by recall in steps, equal scores taken together; sums run over distinct scores."""
    by = df.groupBy(score).agg(F.sum(F.col(bad).cast("int")).alias("y"), F.count(F.lit(1)).alias("n"))
    # Distinct scores are cut into ranges, so that no task sums them all: totals of the ranges above come from a small table.
    by = by.withColumn("_part", F.floor(F.col(score) * 64))
    above = Window.orderBy(F.col("_part").desc()).rowsBetween(START, -1)
    parts = by.groupBy("_part").agg(F.sum("y").alias("_y"), F.sum("n").alias("_n")).withColumns({"_y0": F.coalesce(F.sum("_y").over(above), F.lit(0)), "_n0": F.coalesce(F.sum("_n").over(above), F.lit(0))}).select("_part", "_y0", "_n0")
    w = Window.partitionBy("_part").orderBy(F.col(score).desc()).rowsBetween(START, 0)
    x = by.join(parts, "_part").withColumns({"cy": F.sum("y").over(w) + F.col("_y0"), "cn": F.sum("n").over(w) + F.col("_n0")})
    return x.agg((F.sum(F.col("y") * F.col("cy") / F.col("cn")) / F.nullif(F.sum("y"), F.lit(0))).alias("average_precision"))


def retest(df: DataFrame, scores: list[str], bad: str, tie: str, rate: float) -> DataFrame:
    """One row a score: rows, positives, recall at the rate and average precision."""
    out = None
    for score in scores:
        r = recall_at_rate(df, score, bad, tie, rate).select("positives", "recall")
        x = r.crossJoin(average_precision(df, score, bad)).crossJoin(df.agg(F.count(F.lit(1)).alias("n"))).withColumn("score", F.lit(score))  # one row each
        out = x if out is None else out.unionByName(x)
    return out


def kth_of_last(df: DataFrame, keys: list[str], order: list[str], score: str, k: int = 2, n: int = 10, into: str = "kth") -> DataFrame:
    """The k-th largest score of each row's last n: `k of the last n` over a threshold is this over it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn(into, F.get(F.sort_array(F.collect_list(score).over(w), asc=False), F.lit(k - 1)))


def order_statistic_threshold(df: DataFrame, keys: list[str], order: list[str], score: str, rate: float, k: int = 2, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """One row for the table, or per group `by`: the score threshold at which `k of the last n over it` covers the rate of the rows.

    A row alarms when the k-th largest score of its last n is over the threshold, so the threshold is a quantile of that.
    """
    return grouped_quantiles(kth_of_last(df, keys, order, score, k, n), by or [], "kth", {"threshold": 1 - rate})
