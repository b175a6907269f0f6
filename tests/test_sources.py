"""All sources staged from files: types, casts and normal forms of every table; pruned reads of curves."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plantlens.sources import schemas, tables

#: A text for a column of each type as the source systems write it, and what it is read as.
WRITTEN = {"string": ("x1", "x1"), "double": ("2.5", 2.5), "bigint": ("7", 7), "date": ("2026-01-05", date(2026, 1, 5)), "timestamp_ntz": ("2026-01-05 06:07:08", datetime(2026, 1, 5, 6, 7, 8)), "boolean": ("true", True)}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sources")
    for name, ddl in schemas.CSV.items():
        if name.startswith("seeds/"):
            continue
        fields = spark.createDataFrame([], ddl).schema
        special = {"part_number": "pn 123", "defect_code": "Blk spk", "defect_code_raw": "non fill", "defect_codes": "flash:2;sink:1" if name == "qms/sort_dispositions" else "", "reason_code": "unknown", "hour_bucket": "2"}
        (at / name).parent.mkdir(exist_ok=True)
        row = [special.get(f.name, WRITTEN[f.dataType.simpleString()][0]) for f in fields]
        (at / f"{name}.csv").write_text(",".join(f.name for f in fields) + "\n" + ",".join(row) + "\n")
    for name, columns in schemas.TEXT_CSV.items():
        special = {"approval_ts": "2026-01-05 06:07:08", "approved": "True", "shots_to_approval": "n/a", "part_weight_g": "20.5"}
        (at / f"{name}.csv").write_text(",".join(columns) + "\n" + ",".join(special.get(c, "t") for c in columns) + "\n")
    shots = spark.createDataFrame([(k, "M1", datetime(2026, 1 + k // 30, 1 + k % 28), None if k == 3 else 1.0) for k in range(60)], "shot_id long, mold_id string, shot_ts timestamp_ntz, pack_integral double")
    tables.partitioned(shots, str(at / "monitoring/cavity_shot_summary"))
    tables.partitioned(shots.select("shot_id", "shot_ts", F.lit(" ").alias("press_alarm_code")), str(at / "mes/machine_shot_data"))
    curves = shots.select("shot_id", F.concat(F.lit("M"), F.col("shot_id") % 3).alias("mold"), "shot_ts", F.lit("S").alias("sensor_id"), F.lit(5).alias("t_ms"), F.lit(1).alias("pressure_bar"))
    tables.partitioned(curves, str(at / "monitoring/cavity_curves"), also=("mold",))
    return str(at)


def test_every_source_is_staged(spark, root):
    assert set(tables.STAGED) == {n for n in (*schemas.CSV, *schemas.TEXT_CSV, *schemas.PARQUET) if not n.startswith("seeds/")} and len(tables.STAGED) == 25
    t = tables.staged(spark, root)
    assert set(t) == {n.split("/")[1] for n in tables.STAGED} | {"resin_grades"}
    assert all(df.count() >= 1 for df in t.values())


@pytest.mark.parametrize("name", sorted(n for n in schemas.CSV if not n.startswith("seeds/")))
def test_columns_have_their_types(spark, root, name):
    df = tables.staged(spark, root)[name.split("/")[1]]
    row, declared = df.first().asDict(), {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schemas.CSV[name]).schema}
    changed = {"part_number", "defect_code", "defect_codes", "defect_code_raw", "defect_code_clean", "reason_code", "hour_bucket", "cavity_id", "attributed_cavity_id", "date_code", "qty", "tray_row"}
    for c, kind in declared.items():
        if c not in changed:
            assert row[c] == WRITTEN[kind][1] and df.schema[c].dataType.simpleString() == kind, c


def test_normal_forms(spark, root):
    t = {k: df.first().asDict() for k, df in tables.staged(spark, root).items() if k not in ("cavity_curves", "cavity_shot_summary", "machine_shot_data")}
    assert t["production_orders"]["part_number"] == "P-123"
    assert t["scrap_events"]["defect_code"] == "black_specks" and t["inspection_records"]["defect_code"] == "short_shot" and t["inspection_records"]["failed_share"] == 1.0
    assert t["scrap_tallies"]["defect_code"] == "Blk spk" and t["scrap_tallies"]["hour_ts"] == datetime(2026, 1, 6, 2)
    assert (t["setpoint_changes"]["reason"], t["setpoint_changes"]["delta"]) == (None, 0.0)
    assert t["sort_dispositions"]["codes"] == "flash;sink" and t["qc_audit_pieces"]["defect_codes"] is None
    a = t["first_shot_approvals"]
    assert (a["approval_ts"], a["approved"], a["shots_to_approval"], a["part_weight_g"]) == (datetime(2026, 1, 5, 6, 7, 8), True, None, 20.5)
    assert (t["customer_returns"]["date_code"], t["customer_returns"]["qty"], t["customer_returns"]["attributed_cavity_id"]) == ("7", 7.0, 7)


def test_parquet_sources(spark, root):
    t = tables.staged(spark, root)
    assert t["cavity_shot_summary"].where("dropout").count() == 1
    assert t["machine_shot_data"].where("press_alarm_code is null").count() == 60
    assert dict(t["cavity_curves"].dtypes)["pressure_bar"] == "double"


def files_read(df):
    """Files that a run of df opens, by its scans' metrics."""
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.metrics().contains("numFiles") and "cavity_curves" in node.toString():
            n += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return n


def test_curves_of_few_shots_read_their_folders_only(spark, root):
    path = f"{root}/monitoring/cavity_curves"
    all_ = files_read(spark.read.parquet(path))
    assert all_ >= 6  # two months of three moulds
    shots = spark.createDataFrame([(3, "M0"), (6, "M0")], "shot_id long, mold string").withColumn("month", F.lit("2026-01"))
    shots = tables.materialised(shots, "few")
    got = tables.rows_of(spark, path, shots, "shot_id", ["t_ms", "pressure_bar"], folders=("month", "mold"))
    assert got.count() == 2
    assert 1 <= files_read(got) <= all_ // 6 + 1
