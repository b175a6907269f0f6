"""Reading the source systems in place, staging them, and writing partitioned tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalized_code, ratio, without_prefix
from . import schemas


def read_csv(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A CSV table with its declared schema; all-text tables as text."""
    if name in schemas.TEXT_CSV:
        schema = ", ".join(f"{c} string" for c in schemas.TEXT_CSV[name])
    else:
        schema = schemas.CSV[name]
    return spark.read.schema(schema).csv(f"{root}/{name}.csv", header=True)


def read_parquet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table; filters on month and mold prune its folders."""
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_parquet(spark, root, name) if name in schemas.PARQUET else read_csv(spark, root, name)


def partitioned(df: DataFrame, path: str, ts: str = "shot_ts", also: tuple[str, ...] = (), rows_a_file: int = 1_000_000) -> None:
    """df by month (and `also`), zstd; files are bounded in rows, and a month's rows are dealt to as many tasks as they need."""
    x = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    x.hint("rebalance", "month", *also).write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).partitionBy("month", *also).mode("overwrite").parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialised(df: DataFrame, name: str) -> DataFrame:
    """A model as a table of its own, read again by the models above it: short plans, and no rework for lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def view(df: DataFrame, name: str) -> DataFrame:
    """A model as a view of the session."""
    df.createOrReplaceTempView(name)
    return df


def result(df: DataFrame, path: str) -> None:
    """A result where path ends in .parquet, .csv (with header) or .json; CSV and JSON are for small summaries, one file each."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no sink for {path}")
    if kind == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        df.coalesce(1).write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)


def seed(spark: SparkSession, name: str) -> DataFrame:
    """A seed table of schemas.SEEDS, small by its definition."""
    return spark.createDataFrame(schemas.SEEDS[name], schemas.CSV[f"seeds/{name}"])


def with_month_of(df: DataFrame, shots: DataFrame, key: str = "shot_id", ts: str = "shot_ts", default: str = "unknown") -> DataFrame:
    """Month of a table without a timestamp, from another by key."""
    months = shots.groupBy(key).agg(F.date_format(F.min(ts), "yyyy-MM").alias("month"))
    return df.join(months, key, "left").withColumn("month", F.coalesce("month", F.lit(default)))


def rows_of(spark: SparkSession, path: str, ids: DataFrame, key: str, columns: list[str], folders: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the rows whose key is in ids; only these columns are read.

    `folders`: partition columns of the table that ids has too. The folders that ids name, at most as many as the table
    has, become a filter on its scan, so a short list of shots opens few files.
    """
    rows = spark.read.parquet(path)
    if folders:
        named = ids.select(*folders).distinct().collect()
        for i, f in enumerate(folders):
            rows = rows.where(F.col(f).isin([v for v in dict.fromkeys(r[i] for r in named) if v is not None]))
    own = ids.select(key, *folders).distinct()
    return rows.select(key, *folders, *[c for c in columns if c != key and c not in folders]).join(own, [key, *folders], "left_semi").select(key, *[c for c in columns if c != key])


def head(df: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows, the same on every run: those of the smallest hash of key and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def _try(c: str, kind: str) -> Column:
    return F.col(c).try_cast(kind).alias(c)


def staged_approvals(df: DataFrame) -> DataFrame:
    """First-shot approvals from text."""
    return df.select("job_id", "press_id", "mold_id", _try("approval_ts", "timestamp_ntz"), "technician_id", "inspector_id", _try("shots_to_approval", "int"), _try("part_weight_g", "double"), "dimension_values", "visual_result", (F.lower("approved") == "true").alias("approved"), "template_id_established")


def staged_orders(df: DataFrame) -> DataFrame:
    """Production orders, part numbers in one form: P- and what follows the prefix that was typed."""
    return df.withColumn("part_number", F.concat(F.lit("P-"), without_prefix(F.col("part_number"), ("PART", "PN", "P"))))


def staged_sorts(df: DataFrame) -> DataFrame:
    """Sort dispositions; codes of `code:qty` texts also as a list of codes."""
    codes = F.transform(F.split("defect_codes", ";"), lambda x: F.split_part(x, F.lit(":"), F.lit(1)))
    return df.withColumn("codes", F.when(F.col("defect_codes") != "", F.array_join(codes, ";")))


def staged_tallies(df: DataFrame) -> DataFrame:
    """Tallies with the hour they stand for: the last shift runs past midnight, so buckets before six belong to the next calendar day."""
    hour = F.col("hour_bucket").cast("int")
    rolls = hour < 6
    at = F.col("shift_date").cast("timestamp_ntz") + F.make_dt_interval(hours=hour) + F.make_dt_interval(days=F.when(rolls, 1).otherwise(0))
    return df.withColumns({"hour_ts": at, "cavity_id": F.col("cavity_id").cast("int")})


def staged_setpoints(df: DataFrame) -> DataFrame:
    """Setpoint changes with their size; a reason that is unknown is null."""
    return df.withColumn("delta", F.col("new_value") - F.col("old_value")).withColumn("reason", F.nullif(F.col("reason_code"), F.lit("unknown"))).drop("reason_code")


def staged_shots(df: DataFrame) -> DataFrame:
    """Sensor rows; a dropout has no pack integral."""
    return df.withColumn("dropout", F.col("pack_integral").isNull())


def staged_returns(df: DataFrame) -> DataFrame:
    """Returns; date codes are text, quantities are numbers."""
    return df.withColumns({"attributed_cavity_id": F.col("attributed_cavity_id").cast("int"), "date_code": F.col("date_code").cast("string"), "qty": F.col("qty").cast("double")})


def staged_scrap(df: DataFrame) -> DataFrame:
    """Plant-wide scrap entries with their free-text codes brought to the code list."""
    return df.withColumn("defect_code", normalized_code(F.col("defect_code"), schemas.CODES))


def staged_inspections(df: DataFrame) -> DataFrame:
    """Inspection records with their raw codes brought to the code list, and the share that failed."""
    df = df.withColumn("defect_code", normalized_code(F.col("defect_code_raw"), schemas.CODES)).drop("defect_code_raw", "defect_code_clean")
    return df.withColumn("failed_share", ratio(F.col("quantity_failed").cast("double"), F.col("quantity_inspected")))


def staged_pieces(df: DataFrame) -> DataFrame:
    """Gauged pieces; an empty text of codes is none."""
    return df.withColumns({"defect_codes": F.nullif("defect_codes", F.lit("")), "cavity_id": F.col("cavity_id").cast("int"), "tray_row": F.col("tray_row").cast("int")})


def staged_curves(df: DataFrame) -> DataFrame:
    """Curve points in milliseconds and bar, with shot and sensor."""
    return df.withColumns({"t_ms": F.col("t_ms").cast("double"), "pressure_bar": F.col("pressure_bar").cast("double")})


def trimmed(df: DataFrame) -> DataFrame:
    """Texts without blanks around them, empty ones null: tables whose types are already those of their schema."""
    return df.withColumns({f.name: F.nullif(F.trim(F.col(f.name)), F.lit("")) for f in df.schema.fields if f.dataType.simpleString() == "string"})


#: What each source is staged with.
STAGED = {
    "engineering/process_sheets": trimmed,
    "erp/part_attributes": trimmed,
    "erp/production_orders": staged_orders,
    "hr/inspectors": trimmed,
    "hr/operators": trimmed,
    "hr/technicians": trimmed,
    "materials/dryer_log": trimmed,
    "materials/material_loads": trimmed,
    "materials/resin_lots": trimmed,
    "mes/machine_shot_data": trimmed,
    "mes/presses": trimmed,
    "monitoring/cavity_curves": staged_curves,
    "monitoring/cavity_shot_summary": staged_shots,
    "monitoring/templates": trimmed,
    "qms/customer_returns": staged_returns,
    "qms/first_shot_approvals": staged_approvals,
    "qms/inspection_records": staged_inspections,
    "qms/qc_audit_pieces": staged_pieces,
    "qms/qc_audits": trimmed,
    "qms/scrap_events": staged_scrap,
    "qms/scrap_tallies": staged_tallies,
    "qms/setpoint_changes": staged_setpoints,
    "qms/sort_dispositions": staged_sorts,
    "toolroom/equipment_service": trimmed,
    "toolroom/mold_maintenance": trimmed,
}


def staged(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All 25 sources by their last name, staged; the seed beside them."""
    names = [*(n for n in schemas.CSV if not n.startswith("seeds/")), *schemas.TEXT_CSV, *schemas.PARQUET]
    out = {n.split("/")[1]: STAGED[n](read(spark, root, n)) for n in names}
    return out | {"resin_grades": seed(spark, "resin_grades")}
