"""Anomaly scores: isolation forests by group, trees built by Spark tasks; reconstruction error of principal components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialised

TREES, SAMPLE, FIT_ROWS = 200, 4096, 60_000
#: Rows that one task scores with a group's forest at a time.
CHUNK = 200_000


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grown(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[list[int], list[float], list[int]]:
    """A tree as (feature, cut, low child) of its nodes; the high child follows the low one. A leaf has feature -1 and as its cut what its rows add to the path."""
    feature, cut, low, todo = [-1], [0.0], [0], [(0, x, depth)]
    while todo:
        node, rows, left = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 and left else []
        if not len(spread):
            cut[node] = average_path(len(rows))
            continue
        f = int(rng.choice(spread))
        at = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        feature[node], cut[node], low[node] = f, at, len(feature)
        below = rows[:, f] < at
        for part in (rows[below], rows[~below]):
            todo.append((len(feature), part, left - 1))
            feature.append(-1)
            cut.append(0.0)
            low.append(0)
    return feature, cut, low


def depths(feature: np.ndarray, cut: np.ndarray, low: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Path length of each row through a tree."""
    at, steps, going = np.zeros(len(x), np.int64), np.zeros(len(x)), np.arange(len(x))
    while len(going):
        node = at[going]
        inner = feature[node] >= 0
        going, node = going[inner], node[inner]
        at[going] = low[node] + (x[going, feature[node]] >= cut[node])
        steps[going] += 1
    return steps + cut[at]


def fit_forest(df: DataFrame, group: str, row_id: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """One row per group and tree: its nodes as arrays. Each tree has up to `sample` rows of its group.

    A row is in a tree's sample where a hash of both is under a threshold that lets a few more pass than are wanted; the
    smallest are kept. The trees that draw a row are found within the row, so only drawn rows are laid out and shuffled. Of
    groups of over fit_rows rows, rows whose own hash is under a threshold are used, about so many. A tree is built in one
    task from its sample. Rows with a missing feature are not used; a group without rows has no tree.
    """
    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    used = df.where(" and ".join(f"{f} is not null" for f in features)).select(F.col(group).alias("_g"), F.col(row_id).alias("_id"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    sizes = used.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_g", "_of")
    used = used.join(sizes, F.col("_g").eqNullSafe(F.col("_of"))).where(unit(F.col("_id")) < fit_rows / F.col("_n"))
    pass_ = (sample + 6 * math.sqrt(sample)) / F.least(F.col("_n"), F.lit(fit_rows))
    drawing = F.filter(F.sequence(F.lit(1), F.lit(trees)), lambda t: unit(F.col("_id"), t) < pass_)
    drawn = used.withColumn("tree", F.explode(drawing)).withColumn("_o", unit(F.col("_id"), F.col("tree")))
    drawn = drawn.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "tree").orderBy("_o", "_id"))).where(F.col("_k") <= sample)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        tree = int(pdf["tree"].iat[0])
        x = pdf[[f"_x{i}" for i in range(len(features))]].to_numpy()
        feature, cut, low = grown(x, np.random.default_rng([seed, tree]), math.ceil(math.log2(max(2, len(x)))))
        return pd.DataFrame({group: [pdf["_g"].iat[0]], "tree": [tree], "n": [len(x)], "feature": [feature], "cut": [cut], "low": [low]})

    kind = df.schema[group].dataType.simpleString()
    return drawn.groupBy("_g", "tree").applyInPandas(build, f"{group} {kind}, tree int, n int, feature array<int>, cut array<double>, low array<int>")


def score_forest(df: DataFrame, forest: DataFrame, group: str, features: list[str], into: str = "anomaly", chunk: int = CHUNK) -> DataFrame:
    """df with the anomaly score of its group's forest (null features count as 0; groups without a forest: null).

    Rows of a group are dealt to chunks by a hash, about `chunk` rows each, and every chunk meets its group's trees in one
    task: no forest goes through the driver, and a group that holds most rows has most chunks.
    """
    import pyarrow as pa

    # A repeated row goes with its copies, but no group can be all copies of one row and large: the number spreads them.
    dealt = df.withColumn("_g", F.col(group)).withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    sizes = df.groupBy(F.col(group).alias("_of")).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / chunk)).cast("int").alias("_chunks"))
    dealt = dealt.join(sizes, F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_chunk", F.pmod(F.col("_at"), F.col("_chunks")).cast("int")).drop("_of", "_chunks", "_at")
    trees = forest.withColumnRenamed(group, "_g").join(sizes, F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).select("_g", "_chunk", "n", "feature", "cut", "low")
    names = df.columns

    def score(rows: pa.Table, own: pa.Table) -> pa.Table:
        out = rows.select(names)
        if not own.num_rows or not rows.num_rows:
            return out.append_column(into, pa.nulls(rows.num_rows, pa.float64()))
        x = np.column_stack([rows.column(f).cast(pa.float64()).fill_null(0.0).to_numpy() for f in features])
        total = np.zeros(len(x))
        for tree in own.select(["feature", "cut", "low"]).to_pylist():
            total += depths(np.array(tree["feature"]), np.array(tree["cut"]), np.array(tree["low"]), x)
        mean = total / own.num_rows
        return out.append_column(into, pa.array(2.0 ** (-mean / max(average_path(own.column("n")[0].as_py()), 1e-9))))

    schema = T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())])
    return dealt.groupBy("_g", "_chunk").cogroup(trees.groupBy("_g", "_chunk")).applyInArrow(score, schema)


def reconstruction_error(df: DataFrame, vector: str, k: int, into: str = "error") -> DataFrame:
    """df with the squared distance of its array column from its projection on k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    size = len(x.select(vector).first()[0])
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(x)
    components = model.pc.toArray().tolist()
    mean = x.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()  # as many rows as the vector is long
    centre = F.array(*[F.lit(float(r["m"])) for r in mean])
    moved = F.zip_with(F.col(vector).cast("array<double>"), centre, lambda a, b: a - b)
    y = model.transform(x).withColumns({"_c": moved, "_q": vector_to_array("_p")})
    shift = [sum(components[i][j] * float(mean[i]["m"]) for i in range(size)) for j in range(k)]
    total = F.aggregate("_c", F.lit(0.0), lambda s, v: s + v * v)
    kept = F.aggregate(F.zip_with("_q", F.array(*[F.lit(float(s)) for s in shift]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return y.withColumn(into, F.greatest(F.lit(0.0), total - kept)).drop("_v", "_p", "_c", "_q")


def fit_components(df: DataFrame, group: str, vector: str, good: Column, k: int, least: int = 500) -> DataFrame:
    """One row per group with `least` good rows: n, mean and the k principal components of their vectors, all of one length.

    Tasks sum vectors and their products by group; sums of a group are as many numbers as a vector has, squared, and meet in
    one task, which has its eigenvectors.
    """
    import pyarrow as pa

    own = df.where(good & F.col(vector).isNotNull()).select(F.col(group).alias("_g"), F.transform(vector, lambda v: v.cast("double")).alias("_v"))

    def summed(batches):
        totals: dict = {}
        for batch in batches:
            x = np.array(batch.column("_v").to_pylist(), dtype=np.float64)
            of = np.array(batch.column("_g").to_pylist(), dtype=object)
            for g in dict.fromkeys(of.tolist()):
                rows = x[[h == g for h in of]]
                n, total, products = totals.get(g, (0, 0.0, 0.0))
                totals[g] = (n + len(rows), total + rows.sum(axis=0), products + rows.T @ rows)
        for g, (n, total, products) in totals.items():
            values = np.concatenate([[n], total, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(values), kind), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["_g", "i", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[group].dataType)
    parts = own.mapInArrow(summed, f"_g {df.schema[group].dataType.simpleString()}, i int, v double").groupBy("_g", "i").agg(F.sum("v").alias("v"))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("i")["v"].to_numpy()
        size = int(round((math.sqrt(4 * len(v) - 3) - 1) / 2))
        n, mean = v[0], v[1 : size + 1] / v[0]
        if n < least:
            return pd.DataFrame(columns=[group, "n", "mean", "components"], dtype=object)
        covariance = v[size + 1 :].reshape(size, size) / n - np.outer(mean, mean)
        _, axes = np.linalg.eigh(covariance)
        return pd.DataFrame({group: [pdf["_g"].iat[0]], "n": [int(n)], "mean": [mean.tolist()], "components": [axes[:, ::-1][:, :k].T.tolist()]})

    return parts.groupBy("_g").applyInPandas(solved, f"{group} {df.schema[group].dataType.simpleString()}, n long, mean array<double>, components array<array<double>>")


def curve_errors(df: DataFrame, group: str, vector: str, good: Column, k: int = 12, rate: float = 0.003, least: int = 500, into: str = "error") -> DataFrame:
    """df with the mean squared distance of each curve from its projection on its group's k components, the group's threshold, and a flag.

    Components and threshold come from the good rows alone; the threshold is the quantile of their errors at 1 - rate.
    Groups with fewer than `least` good rows, and rows without a vector, have null errors and no flag.
    """
    from .quantiles import grouped_quantiles

    models = fit_components(df, group, vector, good, k, least).withColumnsRenamed({group: "_g", "mean": "_mean", "components": "_axes"}).drop("n")
    x = df.join(models, F.col(group) == F.col("_g"), "left")
    off = F.zip_with(F.transform(vector, lambda v: v.cast("double")), "_mean", lambda a, b: a - b)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    kept = F.aggregate(F.transform("_axes", lambda axis: F.pow(dot(axis, F.col("_off")), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    x = x.withColumn("_off", off).withColumn(into, F.when(F.col("_off").isNotNull(), F.greatest(F.lit(0.0), dot(F.col("_off"), F.col("_off")) - kept) / F.size("_mean"))).drop("_off", "_mean", "_axes", "_g")
    x = materialised(x, "errors")
    limits = grouped_quantiles(x.where(good), [group], into, {"threshold": 1 - rate}).drop("n").withColumnRenamed(group, "_g")
    x = x.join(limits, F.col(group) == F.col("_g"), "left").drop("_g")
    return x.withColumn("flagged", F.coalesce(F.col(into) > F.col("threshold"), F.lit(False)))
