"""The moulding schema: operators composed to shot context, shot, job and job-hour facts, defects and charts.

`build` takes staged source tables by name and returns the models by name; each is a function of DataFrames, so Spark
plans across them. Write the ones that several others read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import deviation as D
from ..operators import drift as R
from ..operators import labels as L
from ..operators import spc as C
from ..operators import windows as W
from ..sources.schemas import BANDED

#: Fixed values of the domain: logged events and setpoint parameters, snapshot and maturity.
MOLD_EVENTS = ("vent_cleaning", "hot_runner_tip", "PM", "cavity_block", "cavity_unblock", "sensor_recalibration")
PARAMETERS = ("injection_velocity_mm_s", "switchover_position_mm", "hold_pressure_bar", "mold_temp_c", "melt_temp_c")
DRIFT_REASONS = ("drift_correction", "defect_response")
SNAPSHOT, MATURITY_DAYS = "2026-04-30 00:00:00", 21
DETECTORS = ("ewma_pack", "ewma_fill", "cusum_eof", "cusum_gate_seal", "cusum_pack_var")
CAVITIES_A_CELL = 32
#: Chart metrics; values taken relative to a job's start, with the shot column each comes from; the machine's own values.
CHARTED = ("fill_integral", "pack_integral", "cycle_integral", "end_of_fill_pressure_bar", "gate_seal_time_s")
RELATIVE = {
    "pg_fill_time_to_sensor_rel": "fill_time_to_sensor_s_post_gate",
    "pg_time_to_peak_rel": "time_to_peak_s_post_gate",
    "pg_cooling_rate_rel": "cooling_rate_post_gate",
    "pg_cycle_integral_rel": "cycle_integral_post_gate",
    "fill_time_rel": "fill_time_s",
    "recovery_time_rel": "recovery_time_s",
    "peak_injection_pressure_rel": "peak_injection_pressure_bar",
    "switchover_pressure_rel": "switchover_pressure_bar",
    "cycle_time_rel": "cycle_time_s",
}
MACHINE = ("cycle_time_s", "fill_time_s", "switchover_position_mm", "switchover_pressure_bar", "peak_injection_pressure_bar", "cushion_mm", "hold_pressure_bar", "recovery_time_s", "back_pressure_bar", "screw_rpm", "barrel_zone_3_actual_c", "nozzle_actual_c", "mold_temp_a_c", "mold_temp_b_c", "clamp_tonnage", "press_alarm_code")
RULE_LABELS = {"we1": "WE1", "we2": "WE2", "we4": "WE4", "we5": "WE5", "mr_rule": "MR"}
#: Presses and moulds see years of shots: their logs and counters are worked on by this bucket of time.
BUCKET = "day"


def banded_sensors(sensors: DataFrame, templates: DataFrame) -> DataFrame:
    """Sensor rows with the template in force, deviations and recomputed state."""
    keys = ["mold_id", "press_id", "sensor_id"]
    bands = [f"{v}_{b}" for v in BANDED for b in ("template_value", "warning_low", "warning_high", "alarm_low", "alarm_high")]
    x = A.interval_join(sensors, templates, keys, "shot_ts", "effective_from", ["template_id", "match_score_threshold", *bands], tie="template_id")
    col = lambda v, b: F.col(f"{v}_{b}")
    dev = {f"{v}_dev": D.deviation(F.col(v), col(v, "template_value"), col(v, "alarm_low"), col(v, "alarm_high")) for v in BANDED}
    alarms = [D.outside(F.col(v), col(v, "alarm_low"), col(v, "alarm_high")) for v in BANDED]
    warnings = [D.outside(F.col(v), col(v, "warning_low"), col(v, "warning_high")) for v in BANDED]
    state = D.alarm_state(alarms, warnings, F.col("pack_integral").isNull(), F.col("template_match_score") < F.col("match_score_threshold"))
    return x.withColumns(dev).withColumns({"recomputed_state": state, "match_computed": D.match_score([F.col(c) for c in dev]), "out_of_band": D.triggered({v: F.col(f"{v}_dev") for v in BANDED})}).drop("valid_from", "valid_to", *bands)


def shot_summary(sensors: DataFrame) -> DataFrame:
    """One row per shot from its sensor rows."""
    places = ("post_gate", "end_of_fill")
    plain = ("cooling_rate", "cycle_integral", "fill_time_to_sensor_s", "time_to_peak_s", "pressure_at_transfer_bar")
    values = {f"{v}_{p}": (v, f"sensor_position = '{p}'") for v in (*BANDED, *plain) for p in places}
    values |= {f"{v}_dev_{p}": (f"{v}_dev", f"sensor_position = '{p}'") for v in BANDED for p in places}
    head = [F.min(c).alias(c) for c in ("press_id", "mold_id", "shot_ts", "cycle_no", "template_id")]
    head += [F.min("job_id").alias("unit_job_id"), F.bool_or(F.col("sort_signal") == "reject").alias("rejected"), F.bool_or("curve_retained").alias("curve_retained"), F.min("template_match_score").alias("match_score"), F.count_if(F.col("pack_integral").isNull()).alias("n_dropouts"), D.state_label(F.max(D.state_code(F.col("alarm_state")))).alias("unit_alarm_state")]
    # A shot's rows are few and come from several sensors: dealt first, they are sorted and summed in one place.
    return D.rolled_up(sensors.repartition("shot_id"), ["shot_id"], "recomputed_state", [f"{v}_dev" for v in BANDED], "sensor_id", values, also=tuple(head))


def shot_jobs(shots: DataFrame, orders: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Shots with the job that the latest order of their press and mould gives, and whether the unit's own field differs.

    Where either job is not known, unit_job_stale is null. `times`: the sensor rows, whose times are read in place of the
    shots'. Orders are few a day, press and mould, so each is a range of time.
    """
    o = orders.where("actual_start is not null").select("press_id", "mold_id", "actual_start", "job_id", "work_order_id")
    x = A.interval_join(shots, o, ["press_id", "mold_id"], "shot_ts", "actual_start", ["job_id", "work_order_id"], tie="job_id", times=times).drop("valid_from", "valid_to")
    return x.withColumn("unit_job_stale", F.col("unit_job_id") != F.col("job_id"))


def cell_orders(orders: DataFrame, presses: list[str] | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Orders of the instrumented cell: of the given presses, and of moulds whose part is known."""
    x = orders if presses is None else orders.where(F.col("press_id").isin(presses))
    return x if parts is None else x.join(parts.select("mold_id").distinct(), "mold_id", "left_semi")


def jobs(orders: DataFrame, approvals: DataFrame, shots: DataFrame, technicians: DataFrame) -> DataFrame:
    """Job header: order, approval, run window, maturity, the technician's earlier approvals on the mould and tenure.

    Every order has a row, also one without shots or approval. Earlier approvals count orders of the same mould and
    technician, those without a time last.
    """
    run = shots.groupBy("job_id").agg(F.min("shot_ts").alias("first_shot_ts"), F.max("shot_ts").alias("last_shot_ts"), F.count(F.lit(1)).alias("n_shots"))
    a = approvals.select("job_id", "approval_ts", "technician_id", "inspector_id", "shots_to_approval", "approved", "template_id_established")
    x = orders.join(a, "job_id", "left").join(run, "job_id", "left").join(technicians.select("technician_id", "hire_date"), "technician_id", "left")
    before = Window.partitionBy("mold_id", "technician_id").orderBy(F.col("approval_ts").asc_nulls_last(), "job_id").rowsBetween(W.START, -1)
    matures = F.col("last_shot_ts") + F.make_dt_interval(days=F.lit(MATURITY_DAYS))
    return x.withColumns({
        "prior_runs": F.count(F.lit(1)).over(before),
        "tenure_days": S.boundaries("day", F.col("hire_date").cast("timestamp_ntz"), F.col("approval_ts")),
        "matures_on": matures,
        "matured": matures <= F.lit(SNAPSHOT).cast("timestamp_ntz"),
    }).drop("hire_date")


def mold_events(maintenance: DataFrame, service: DataFrame, shots: DataFrame) -> DataFrame:
    """Maintenance and equipment events in one table, with the shot counter of the mould or press when they happened: 0 before any shot."""

    def counted(log: DataFrame, key: str) -> DataFrame:
        return W.counted(log, shots, [key], "event_ts", "shot_ts", "counter_at_event", BUCKET)

    m = counted(maintenance.select("mold_id", "event_ts", "event_type"), "mold_id")
    p = counted(service.select("press_id", "event_ts", F.concat_ws("_", "equipment", "event_type").alias("event_type")), "press_id")
    return L.union_sources({"mold_maintenance": m, "equipment_service": p})


def lot_changes(loads: DataFrame) -> DataFrame:
    """Loads that bring another lot to a press than the one before; its first load is such a change."""
    before = F.lag("resin_lot_id").over(Window.partitionBy("press_id").orderBy("load_ts", "load_id"))
    return loads.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("resin_lot_id"))).select("press_id", F.col("load_ts").alias("change_ts"), F.col("load_id").alias("change_id"))


def press_log(t: dict[str, DataFrame]) -> DataFrame:
    """Loads, lot changes, corrections and equipment events of presses in one log. A correction has two different known values."""
    loads = t["material_loads"].withColumn("first_load_ts", F.min("load_ts").over(Window.partitionBy("press_id", "resin_lot_id")))
    drift = t["setpoint_changes"].where(F.col("reason").isin(*DRIFT_REASONS) & (F.col("old_value") != F.col("new_value")))
    return L.union_sources({
        "load": loads.select("press_id", F.col("load_ts").alias("log_ts"), F.lit("load").alias("kind"), "load_id", "resin_lot_id", "dryer_id", "regrind_pct", "first_load_ts"),
        "lot_change": t["lot_changes"].select("press_id", F.col("change_ts").alias("log_ts"), F.lit("lot_change").alias("kind")),
        "correction": drift.select("press_id", F.col("change_ts").alias("log_ts"), F.lit("correction").alias("kind")),
        "service": t["mold_events"].where("press_id is not null").select("press_id", F.col("event_ts").alias("log_ts"), F.col("event_type").alias("kind"), F.col("counter_at_event")),
    })


def mold_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Shots and days since each kind of the mould's events, and whether a cavity is blocked."""
    own = t["mold_events"].where("mold_id is not null").select("mold_id", "event_ts", "event_type", "counter_at_event")
    x = A.asof_fused(x, own, ["mold_id"], "shot_ts", "event_ts", "event_type", list(MOLD_EVENTS), ["counter_at_event"], tie="counter_at_event", bucket=BUCKET, number=("shot_id", "mold_counter"))
    for e in MOLD_EVENTS:
        x = x.withColumns({f"shots_since_{e}": F.col("mold_counter") - F.col(f"{e}_counter_at_event"), f"days_since_{e}": S.boundaries("day", F.col(f"{e}_at"), F.col("shot_ts"))}).drop(f"{e}_counter_at_event")
    blocked, freed = F.col("shots_since_cavity_block"), F.col("shots_since_cavity_unblock")
    return x.withColumn("cavity_blocked", blocked.isNotNull() & (freed.isNull() | (blocked < freed)))


def press_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The press's load in force, time since lot changes, corrections and equipment events."""
    kinds = ["load", "lot_change", "correction", "check_ring_replace", "mold_temperature_controller_service"]
    held = ["load_id", "resin_lot_id", "dryer_id", "regrind_pct", "first_load_ts", "counter_at_event"]
    x = A.asof_fused(x, press_log(t), ["press_id"], "shot_ts", "log_ts", "kind", kinds, held, tie="load_id", bucket=BUCKET, number=("shot_id", "press_counter"))
    keep = {"load": held[:-1], "check_ring_replace": ("counter_at_event",)}
    x = x.drop(*[f"{k}_{c}" for k in kinds for c in held if c not in keep.get(k, ())])
    x = x.withColumnsRenamed({"load_load_id": "load_id", "load_resin_lot_id": "resin_lot_id", "load_dryer_id": "dryer_id", "load_regrind_pct": "regrind_pct"})
    days = lambda kind: S.boundaries("hour", F.col(f"{kind}_at"), F.col("shot_ts")) / 24.0
    return x.withColumns({
        "residence_h": S.boundaries("minute", F.col("load_first_load_ts"), F.col("shot_ts")) / 60.0,
        "shots_since_check_ring": F.col("press_counter") - F.col("check_ring_replace_counter_at_event"),
        "ring_days": days("check_ring_replace"),
        "controller_days": days("mold_temperature_controller_service"),
        "hours_since_lot_change": S.boundaries("hour", F.col("lot_change_at"), F.col("shot_ts")),
    })


def dryer_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """What the dryer, known only from the load, last logged."""
    dryer = t["dryer_log"].select("dryer_id", F.col("ts").alias("_ts"), "dew_point_c", "actual_temp_c")
    return A.asof_join(x, dryer, ["dryer_id"], "shot_ts", "_ts", ["dew_point_c", "actual_temp_c"], prefix="dryer_", bucket=BUCKET)


def lot_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The lot's certificate within its grade."""
    position = (F.col("cert_melt_flow_index") - F.col("mfi_band_low")) / F.nullif(F.col("mfi_band_high") - F.col("mfi_band_low"), F.lit(0.0))
    lots = t["resin_lots"].join(t["resin_grades"], "resin_id", "left").select(F.col("lot_id").alias("resin_lot_id"), "resin_id", "supplier_id", "cert_melt_flow_index", "cert_moisture_pct", "hygroscopic", "min_residence_h", position.alias("cert_position"))
    return x.join(lots, "resin_lot_id", "left").withColumn("below_min_residence", F.col("hygroscopic") & (F.col("residence_h") < F.col("min_residence_h")))


def setpoint_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Setpoints in force by job, else those of the process sheet; a change without a new value changes nothing."""
    changes = t["setpoint_changes"].where("new_value is not null").select("job_id", "change_ts", "parameter", "new_value", "change_id")
    x = A.asof_fused(x, changes, ["job_id"], "shot_ts", "change_ts", "parameter", list(PARAMETERS), ["new_value"], tie="change_id", bucket=BUCKET)
    sheet = t["process_sheets"].select("mold_id", "press_id", *[F.col(p).alias(f"sheet_{p}") for p in PARAMETERS], "window_hold_pressure_pct", "window_mold_temp_c", "window_melt_temp_c")
    x = x.join(sheet, ["mold_id", "press_id"], "left")
    return x.withColumns({f"delta_{p}": F.coalesce(F.col(f"{p}_new_value"), F.col(f"sheet_{p}")) - F.col(f"sheet_{p}") for p in PARAMETERS}).drop(*[f"{p}_{c}" for p in PARAMETERS for c in ("new_value", "at")])


def machine_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """The machine's own values, and where they are within the sheet's windows."""
    machine = t["machine_shot_data"]
    return x.join(machine.select("shot_id", *[c for c in MACHINE if c in machine.columns]), "shot_id", "left").withColumns({
        "cushion_position": (F.col("cushion_mm") - 5.0) / 1.5,
        "hold_position": S.ratio((S.ratio(F.col("hold_pressure_bar"), F.col("sheet_hold_pressure_bar")) - 1) * 100, F.col("window_hold_pressure_pct")),
        "melt_position": S.ratio(F.col("nozzle_actual_c") - F.col("sheet_melt_temp_c"), F.col("window_melt_temp_c")),
        "mold_position": S.ratio((F.col("mold_temp_a_c") + F.col("mold_temp_b_c")) / 2 - F.col("sheet_mold_temp_c"), F.col("window_mold_temp_c")),
        "mold_half_difference": F.col("mold_temp_b_c") - F.col("mold_temp_a_c"),
    })


def approval_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Before and after the job's approval."""
    return x.join(t["first_shot_approvals"].select("job_id", "approval_ts"), "job_id", "left").withColumn("after_approval", F.col("shot_ts") >= F.col("approval_ts"))


def approval_counter(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    return W.around(x, ["job_id"], ["shot_ts", "shot_id"], "after_approval", "shots_after_approval", BUCKET)


def season_context(x: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    sine, cosine = S.season(F.col("shot_ts"))
    return x.withColumns({"season_sin": sine, "season_cos": cosine, "shot_month": F.month("shot_ts")})


#: Passes of a shot's context in their order: what each makes, those it reads, whether it reads its rows twice.
PASSES = {
    mold_context: (("mold_counter", "cavity_blocked", *[f"{c}{e}{a}" for e in MOLD_EVENTS for c, a in (("shots_since_", ""), ("days_since_", ""), ("", "_at"))]), (), True),
    press_context: (("press_counter", "load_id", "resin_lot_id", "dryer_id", "regrind_pct", "load_first_load_ts", "check_ring_replace_counter_at_event", *[f"{k}_at" for k in ("load", "lot_change", "correction", "check_ring_replace", "mold_temperature_controller_service")], "residence_h", "shots_since_check_ring", "ring_days", "controller_days", "hours_since_lot_change"), (), True),
    dryer_context: (("dryer_at", "dryer_dew_point_c", "dryer_actual_temp_c"), (press_context,), True),
    lot_context: (("resin_id", "supplier_id", "cert_melt_flow_index", "cert_moisture_pct", "hygroscopic", "min_residence_h", "cert_position", "below_min_residence"), (press_context,), False),
    setpoint_context: ((*[f"{c}_{p}" for p in PARAMETERS for c in ("delta", "sheet")], "window_hold_pressure_pct", "window_mold_temp_c", "window_melt_temp_c"), (), True),
    machine_context: ((*MACHINE, "cushion_position", "hold_position", "melt_position", "mold_position", "mold_half_difference"), (setpoint_context,), False),
    approval_context: (("approval_ts", "after_approval"), (), False),
    approval_counter: (("shots_after_approval",), (approval_context,), True),
    season_context: (("season_sin", "season_cos", "shot_month"), (), False),
}


def passes(columns: tuple[str, ...] | None) -> list[Callable]:
    """The passes that make these columns, all if None, with those that they read, in order."""
    found = [p for p, (makes, _, _) in PASSES.items() if columns is None or set(makes) & set(columns)]
    return [p for p in PASSES if p in found or any(p in PASSES[q][1] for q in found)]


def shot_context(shots: DataFrame, t: dict[str, DataFrame], columns: tuple[str, ...] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A shot's context, one pass per key (mould, press, dryer, job), by buckets.

    `columns`: those that are read, all if None; a pass that makes none of them is left out. `keep` is applied to rows that
    have been through a pass and that the next one reads twice.
    """
    x, fresh = shots, True
    for one in passes(columns):
        if PASSES[one][2]:
            x, fresh = one(x if fresh else keep(x), t), False
        else:
            x = one(x, t)
    return x


def chart_points(sensors: DataFrame, context: DataFrame, baseline: int = 500, fitted: tuple[int, int] = (200, 1000), level_rows: int = 500, least: int = 100, keep: Callable[[DataFrame], DataFrame] = lambda df: df, hold: Callable[[DataFrame], DataFrame] = lambda df: df, compared: tuple[str, ...] = ("textbook", "baseline")) -> DataFrame:
    """Long chart points of production shots with residuals, z scores and rules: of the residual, and of the sigmas `compared` with it (textbook's, baseline's).

    Limits are over the first `baseline` points, fits and own spreads over the shots `fitted` after approval, both included;
    a job without them has points without residuals. `keep` is applied to residuals, which two steps read,
    and `hold` to the pooled spreads, one row a series: written, they are known to be small.
    """
    keys, order = ["job_id", "sensor_id", "metric"], ["shot_ts", "shot_id"]
    own = sensors.drop("job_id").join(context.where("after_approval").select("shot_id", "job_id", "shots_after_approval"), "shot_id")
    long = C.unpivoted(own.where("pack_integral is not null"), ["shot_id", "shot_ts", "job_id", "mold_id", "press_id", "sensor_id", "shots_after_approval"], list(CHARTED))
    first, last = fitted
    x = C.trailing_level(C.charted(long, keys, order), keys, order, level_rows)
    x = C.with_limits_and_fit(x, keys, baseline, first - 1, last, position="shots_after_approval")
    r = keep(C.about_level(x, least))
    sigma = hold(C.pooled_sigma(r, ["job_id"], ["mold_id", "press_id", "sensor_id", "metric"], "shot_ts", first, first - 1, last, position="shots_after_approval").select("job_id", "sensor_id", "metric", "sigma"))
    r = r.join(sigma, keys, "left").withColumns({k: z for k, z in C.z_scores().items() if k == "z" or k.removeprefix("z_") in compared})
    r = C.run_rules(r, keys, order, "z", 4.05, 2.70)
    for sigma_of in compared:
        r = C.run_rules(r, keys, order, f"z_{sigma_of}", prefix=f"{sigma_of}_", rules=("we1", "we2"))
    return C.range_rule(r)


def shot_flags(points: DataFrame, baseline: int = 500) -> DataFrame:
    """Per shot: which rules fired on any of its charts after the baseline, how many charts it has, the largest z.

    Rules 1 and 2 of the textbook's and the baseline's sigma where points have them.
    """
    on = lambda *flags: F.bool_or(F.greatest(*[F.coalesce(F.col(c), F.lit(False)).cast("int") for c in flags], F.lit(0)).cast("boolean") & (F.col("point_no") > baseline))
    rules = list(RULE_LABELS)
    return points.groupBy("shot_id").agg(
        *[on(c).alias(c) for c in rules],
        on(*rules).alias("spc_any"),
        *[on(f"{c}_we1", f"{c}_we2").alias(f"rule12_{c}") for c in ("textbook", "baseline") if f"{c}_we1" in points.columns],
        F.count(F.lit(1)).alias("charts"),
        F.max(F.abs("z")).alias("largest_z"),
    )


def chart_alarms(points: DataFrame, changes: DataFrame, baseline: int = 500, within_s: float = 3600, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """New alarms after the baseline with the rule, and the press's next setpoint change if it comes within an hour."""
    alarms = keep(C.new_alarms(points.where(F.col("point_no") > baseline), ["job_id", "sensor_id", "metric"], RULE_LABELS))
    real = changes.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return C.alarm_disposition(alarms, real, ["press_id"], "shot_ts", "change_ts", ["change_id", "parameter", "reason"], within_s, tie="change_id", bucket=BUCKET)


def drift_state(shots: DataFrame, context: DataFrame, rearm: int = 3000, baseline: int = 500, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Five detectors per production shot: EWMAs of pack and fill, CUSUMs of end of fill (low side), gate seal (both sides) and pack spread.

    All restart at corrections, lot changes, vent cleaning, PM and a new check ring; signals are re-armed. `keep` is applied
    to what several steps read.
    """
    keys, order = ["job_id"], ["shot_ts", "shot_id"]
    devs = {"pack": "pack_integral_dev_post_gate", "fill": "fill_integral_dev_post_gate", "eof": "end_of_fill_pressure_bar_dev_end_of_fill", "gate": "gate_seal_time_s_dev_post_gate"}
    x = shots.select("shot_id", *[F.col(c).alias(k) for k, c in devs.items()]).join(context.where("after_approval").select("shot_id", "job_id", "shot_ts", "correction_at", "lot_change_at", "shots_since_vent_cleaning", "shots_since_PM", "ring_days"), "shot_id")
    x = R.resets(x, keys, order, ("correction_at", "lot_change_at"), {"shots_since_vent_cleaning": 0.0, "shots_since_PM": 0.0, "ring_days": 0.5})
    for name in ("pack", "fill"):
        x = R.ewma(x, keys, order, name, baseline=baseline).withColumnsRenamed({"ewma": f"ewma_{name}", "ewma_signal": f"ewma_{name}_signal"}).drop("ewma_mean", "ewma_sd")
    x = keep(W.numbered(x, keys, order, "position"))
    read = (
        R.cusum(R.block_z(x, keys, order, "eof", baseline=baseline), keys, "position", side=-1, into="cusum_eof"),
        R.two_sided(R.block_z(x, keys, order, "gate", baseline=baseline), keys, "position", into="cusum_gate_seal"),
        R.cusum(spread_blocks(x, keys, order, baseline), keys, "position", k=0.10, h=1.2, into="cusum_pack_var"),
    )
    for name, df in zip(("cusum_eof", "cusum_gate_seal", "cusum_pack_var"), read, strict=True):
        x = R.carried(x.join(df, [*keys, "position"], "left"), keys, order, name)
    x = keep(x.withColumns({f"{d}_signal": F.coalesce(f"{d}_signal", F.lit(False)) for d in DETECTORS}))
    x = R.kept_signals(x, keys, order, list(DETECTORS), rearm=rearm)
    any_of = lambda what: F.greatest(*[F.col(f"{d}_{what}").cast("int") for d in DETECTORS]) > 0
    x = x.withColumns({"drift_any_signal": any_of("signal"), "drift_any_fire": any_of("fire")})
    return x.select("shot_id", "job_id", "shot_ts", F.col("reset").alias("drift_reset"), *DETECTORS, *[f"{d}_{c}" for d in DETECTORS for c in ("signal", "fire")], "drift_any_signal", "drift_any_fire")


def spread_blocks(x: DataFrame, keys: list[str], order: list[str], baseline: int, every: int = 50) -> DataFrame:
    """Readings of the log spread; reset if any row since the reading before was one."""
    latest = F.max(F.when(F.col("reset"), F.col("position"))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(W.START, 0))
    since = F.coalesce(latest > F.col("position") - every, F.lit(False))
    return R.log_spread(x.withColumn("reset", since), keys, order, "pack", last=baseline, every=every)


def drift_signals(state: DataFrame, context: DataFrame, lot_steps: DataFrame, limit: float = 3.0) -> DataFrame:
    """The first signal of each detector in each segment between resets with its statistic, and lot changes whose step is over `limit` t."""
    x = R.segments(state, ["job_id"], ["shot_ts", "shot_id"], "drift_reset").join(context.select("shot_id", "press_id", "mold_id"), "shot_id")
    one = lambda d: F.struct(F.lit(d).alias("detector"), F.col(d).cast("double").alias("statistic"), F.col(f"{d}_signal").alias("on"))
    long = x.select("job_id", "segment", "shot_id", "press_id", "mold_id", "shot_ts", F.explode(F.array(*[one(d) for d in DETECTORS])).alias("_x")).where("_x.on")
    head = ["shot_id", "press_id", "mold_id", "shot_ts"]
    row = F.struct(*head, F.col("_x.statistic").alias("statistic"))
    first = long.groupBy("job_id", "segment", F.col("_x.detector").alias("detector")).agg(F.min_by(row, F.struct("shot_ts", "shot_id")).alias("_first"))
    steps = lot_steps.where(F.abs("step_t") > limit).select(*head, "job_id", F.lit("lot_step").alias("detector"), F.col("step_t").alias("statistic"))
    return first.select("_first.*", "job_id", "detector").unionByName(steps)


def lot_step_tests(shots: DataFrame, context: DataFrame, each: int = 200, least: int = 50, inflation: float = 8.0) -> DataFrame:
    """At each lot change within a job's production: steps of fill integral and peak pressure over the `each` nearest shots on either side.

    One row per job and change after the job's first production shot, with `least` shots on both sides: the shot it first
    holds for, the steps, the spread of fill over all these shots, and t with the sample shrunk for autocorrelation.
    """
    values = {"fill": "fill_integral_dev_post_gate", "peak": "peak_pressure_bar_dev_post_gate"}
    own = context.where("after_approval").select("shot_id", "job_id", "press_id", "mold_id", "shot_ts", "resin_lot_id", "lot_change_at")
    own = own.join(shots.select("shot_id", *[F.col(c).alias(k) for k, c in values.items()]), "shot_id")
    seen = own.groupBy("job_id", "lot_change_at").agg(F.min("resin_lot_id").alias("lot"), F.min("shot_ts").alias("_seen"))
    started = Window.partitionBy("job_id")
    changes = seen.withColumn("_first", F.min("_seen").over(started)).where("lot_change_at > _first").withColumn("change_no", F.xxhash64("job_id", "lot_change_at"))
    head = ["shot_id", "shot_ts", "press_id", "mold_id"]
    x = W.around_events(own.drop("lot_change_at", "resin_lot_id"), changes, ["job_id"], "shot_ts", "shot_id", "lot_change_at", "change_no", each, list(values), head)
    x = x.withColumns({f"{k}_step": F.col(f"{k}_after") - F.col(f"{k}_before") for k in values})
    x = x.where((F.col("n_after") >= least) & (F.col("n_before") >= least)).join(changes.select("change_no", "job_id", "lot_change_at", "lot"), "change_no")
    scale = F.col("fill_sd") * F.sqrt(inflation * (1 / F.col("n_after") + 1 / F.col("n_before")))
    return x.select("job_id", "lot_change_at", F.col("lot").alias("resin_lot_id"), *head, "fill_step", "peak_step", "fill_sd", "n_after", "n_before", (F.col("fill_step") / F.nullif(scale, F.lit(0.0))).alias("step_t"))


def confirmed_defects(t: dict[str, DataFrame], context: DataFrame) -> DataFrame:
    """Defects of four sources by job, press, mould, hour, shot, cavity and code.

    Reviews count where pieces were confirmed. Those of indexed trays have their shot; per-shift ones are spread over the
    shift's hours by the shots sorted there after approval. A gauged piece with codes counts as one, under its text of codes;
    press and mould of tallies and returns are those of their job. `context`: shot_id, job_id, shot_ts, rejected, after_approval.
    """
    hour = S.truncated("hour", F.col("shot_ts")).alias("hour_ts")
    sorts = t["sort_dispositions"].where("pieces_confirmed_defective > 0")
    cell = ["press_id", "mold_id"]
    one = L.exploded_codes(sorts.where("review_mode = 'indexed_tray'"), "defect_codes", ["job_id", *cell, "shot_id"]).join(context.select("shot_id", hour), "shot_id")
    sorted_ = context.where("rejected and after_approval").select("job_id", S.shift_date(F.col("shot_ts")).alias("shift_date"), S.shift_label(F.col("shot_ts")).alias("shift"), hour)
    shift = ["job_id", "shift_date", "shift"]
    per_hour = sorted_.groupBy(*shift, "hour_ts").agg(F.count(F.lit(1)).alias("sorted"))
    totals = L.exploded_codes(sorts.where("review_mode = 'per_shift'"), "defect_codes", [*shift, *cell])
    spread = L.allocated(totals, per_hour, shift, "qty", "sorted").select("job_id", *cell, "hour_ts", "code", F.col("allocated").alias("qty"))
    sorts = one.select("job_id", *cell, "shot_id", "hour_ts", "code", "qty").unionByName(spread, allowMissingColumns=True)
    audits = t["audit_pieces_linked"].where("defect_codes is not null").select("job_id", *cell, "shot_id", "cavity_id", "hour_ts", F.col("defect_codes").alias("code"), F.lit(1.0).alias("qty"))
    homes = t["jobs"].select("job_id", *[F.col(c).alias(f"_{c}") for c in cell])
    tallies = t["scrap_tallies"].join(homes, "job_id", "left").select("job_id", "press_id", F.col("_mold_id").alias("mold_id"), "hour_ts", "cavity_id", F.col("defect_code").alias("code"), F.col("qty").cast("double").alias("qty"))
    returns = t["customer_returns"].withColumn("job_id", F.col("attributed_job_id")).join(homes, "job_id", "left").select("job_id", *[F.col(f"_{c}").alias(c) for c in cell], F.col("attributed_cavity_id").alias("cavity_id"), F.col("defect_code").alias("code"), F.col("qty").cast("double").alias("qty"))
    out = L.union_sources({"sort": sorts, "audit": audits, "tally": tallies, "return": returns})
    return out.select("source", "job_id", *cell, "hour_ts", "shot_id", "cavity_id", "code", "qty")


def by_source(defects: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed quantities of each source by key."""
    qty = lambda *names: F.sum(F.when(F.col("source").isin(*names), F.col("qty")))
    return defects.groupBy(*keys).agg(qty("sort").alias("confirmed_sort"), qty("audit").alias("confirmed_audit"), qty("tally").alias("confirmed_tally"), qty("return").alias("returned"), qty("sort", "audit", "tally").alias("confirmed_total"))


def _zeros(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})


def job_fact(jobs: DataFrame, shots: DataFrame, defects: DataFrame) -> DataFrame:
    """One row per job: header, shots, pieces, sorted and alarmed shots, agreement with the unit, confirmed defects."""
    after = F.coalesce("after_approval", F.lit(False))
    s = shots.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("shots"),
        F.sum(F.when(after, F.col("active_cavities"))).alias("pieces"),
        F.count_if(after & F.col("rejected")).alias("sorted_shots"),
        F.count_if(after & (F.col("unit_alarm_state") == "alarm")).alias("alarm_shots"),
        F.avg(F.when(after, (F.col("unit_alarm_state") == F.col("state")).cast("int"))).alias("unit_state_agreement"),
        F.avg(F.col("unit_job_stale").cast("int")).alias("unit_job_stale_share"),
    )
    d = by_source(defects.where("job_id is not null"), ["job_id"]).drop("confirmed_total")
    return _zeros(jobs.join(s, "job_id", "left").join(d, "job_id", "left"), ("confirmed_sort", "confirmed_audit", "confirmed_tally", "returned"))


def job_hour_fact(shots: DataFrame, defects: DataFrame, alarms: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """One row per job and hour: shots, what each layer raised, confirmed defects, new chart alarms and drift signals."""
    after = F.coalesce("after_approval", F.lit(False))
    on = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))) if c in shots.columns else F.lit(0).cast("long")
    hour = S.truncated("hour", F.col("shot_ts")).alias("hour_ts")
    s = shots.groupBy("job_id", "press_id", "mold_id", hour).agg(
        F.count(F.lit(1)).alias("shots"),
        F.sum("active_cavities").alias("pieces"),
        F.count_if(after).alias("production_shots"),
        F.count_if(F.col("unit_alarm_state") == "alarm").alias("unit_alarm_shots"),
        F.count_if(after & F.col("rejected")).alias("sorted_shots"),
        on("spc_any").alias("spc_rule_shots"),
        on("drift_any_signal").alias("drift_signal_shots"),
        F.avg("pack_integral_dev_post_gate").alias("mean_pack_dev"),
        F.avg("fill_integral_dev_post_gate").alias("mean_fill_dev"),
        F.avg("end_of_fill_pressure_bar_dev_end_of_fill").alias("mean_eof_dev"),
    )
    keys = ["job_id", "hour_ts"]
    s = s.join(by_source(defects.where("hour_ts is not null and job_id is not null"), keys).drop("returned"), keys, "left")
    for name, df in (("spc_alarms", alarms), ("drift_signals", signals)):
        if df is not None:
            s = s.join(df.groupBy("job_id", hour).agg(F.count(F.lit(1)).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return _zeros(s, ("confirmed_sort", "confirmed_audit", "confirmed_tally", "confirmed_total"))


def audit_fact(pieces: DataFrame, attributes: DataFrame, shots: DataFrame) -> DataFrame:
    """Gauged pieces with their part's nominal values, a key of their cavity, and their shot's features where it is known."""
    a = attributes.select("mold_id", "nominal_weight_g", F.col("critical_dimension_mm").alias("nominal_dimension_mm"), "dimension_tolerance_mm", "gauge_sd_weight_g", "gauge_sd_dimension_mm", "standard_cost")
    # Codes of cells ascend by name; cells are few, so one window numbers them.
    cells = pieces.select("mold_id", "press_id").distinct().withColumn("cell_code", F.row_number().over(Window.orderBy("mold_id", "press_id")) - 1)
    x = pieces.drop("shot_ts").join(cells, ["mold_id", "press_id"]).withColumns({"cavity_key": S.cavity_key(F.col("cell_code"), F.col("cavity_id"), CAVITIES_A_CELL), "linked_to_shot": F.col("shot_id").isNotNull()})
    taken = set(x.columns) | set(a.columns)
    return x.join(a, "mold_id", "left").join(shots.select("shot_id", *[c for c in shots.columns if c not in taken]), "shot_id", "left")


def audit_pieces(pieces: DataFrame, audits: DataFrame, shots: DataFrame) -> DataFrame:
    """Gauged pieces with the shot they came from: the press's sampled cycle and their row in the tray. Hand-pulled ones stay unlinked."""
    x = pieces.join(audits.select("audit_id", "job_id", "press_id", "mold_id", "audit_ts", "sampled_shot_cycle_no"), "audit_id").withColumn("cycle_no", (F.col("sampled_shot_cycle_no") + F.col("tray_row")).cast("long"))
    x = x.join(shots.select("press_id", "cycle_no", "shot_id", "shot_ts"), ["press_id", "cycle_no"], "left")
    return x.withColumn("hour_ts", S.truncated("hour", F.coalesce("shot_ts", "audit_ts")))


def with_pieces(shots: DataFrame, attributes: DataFrame) -> DataFrame:
    """Shots with the cavities of their part and how many are active: all but a blocked one. `shots` has cavity_blocked."""
    x = shots.join(attributes.select("mold_id", "cavities").dropDuplicates(["mold_id"]), "mold_id", "left")
    return x.withColumn("active_cavities", F.col("cavities") - F.col("cavity_blocked").cast("int"))


def relative_values(shots: DataFrame, first: int = 500) -> DataFrame:
    """Per shot, values without a template over the median of the job's first `first` production shots, less 1.

    `shots` has after_approval, shots_after_approval and the columns of RELATIVE; those it lacks are left out.
    """
    names = {k: c for k, c in RELATIVE.items() if c in shots.columns}
    if not names:
        return shots.select("shot_id")
    own = shots.where(F.col("after_approval") & (F.col("shots_after_approval") < first))
    base = own.groupBy("job_id").agg(*[F.median(c).alias(f"_{k}") for k, c in names.items()])
    return shots.select("shot_id", "job_id", *names.values()).join(base, "job_id", "left").select("shot_id", *[(S.ratio(F.col(c), F.col(f"_{k}")) - 1).alias(k) for k, c in names.items()])


def shot_labels(sorts: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per shot: its tray review (pieces reviewed and confirmed, codes), and its gauged pieces (number, rejects, codes)."""
    reviews = sorts.where("review_mode = 'indexed_tray'").select("shot_id", "pieces_reviewed", "pieces_confirmed_defective", F.array_join(F.transform(F.split("defect_codes", ";"), lambda x: F.split_part(x, F.lit(":"), F.lit(1))), ";").alias("sort_defect_codes"))
    gauged = pieces.where("shot_id is not null").groupBy("shot_id").agg(F.count(F.lit(1)).alias("audit_pieces"), F.count_if(F.col("visual_result") == "reject").alias("audit_rejects"), F.array_join(F.array_sort(F.collect_list("defect_codes")), ";").alias("audit_defect_codes"))
    return reviews, gauged.withColumn("audit_defect_codes", F.nullif("audit_defect_codes", F.lit("")))


def shot_fact(t: dict[str, DataFrame]) -> DataFrame:
    """One row per shot: context, sensed and relative values, chart rules, drift, and the labels that link to it."""
    head = t["shots"].drop("press_id", "mold_id", "shot_ts", "job_id")
    x = with_pieces(t["shot_context"].join(head, "shot_id"), t["part_attributes"])
    x = x.join(t["jobs"].select("job_id", "technician_id", "prior_runs", "tenure_days", "matured"), "job_id", "left")
    if set(RELATIVE.values()) & set(x.columns):
        x = x.join(relative_values(x), "shot_id", "left")
    reviews, gauged = shot_labels(t["sort_dispositions"], t["audit_pieces_linked"])
    x = x.join(t["shot_flags"], "shot_id", "left").join(t["drift_state"].drop("job_id", "shot_ts"), "shot_id", "left").join(reviews, "shot_id", "left").join(gauged, "shot_id", "left")
    off = [*RULE_LABELS, "spc_any", "drift_any_signal", "drift_any_fire"]
    return x.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in off})


def build(t: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df, presses: list[str] | None = None, read: dict[str, tuple[str, ...]] | None = None, compared: tuple[str, ...] = ("textbook", "baseline")) -> dict[str, DataFrame]:
    """All models from staged tables by their names; `keep` is applied to those that several others read (write or persist).

    `presses`: those of the instrumented cell, all if None; its moulds are those with part attributes. `read`: by model the
    columns that are read, where not all are; others aren't made. `compared`: see chart_points.
    """
    t, read = dict(t), read or {}

    def kept(name: str, df: DataFrame) -> DataFrame:
        return keep(df.select(*[c for c in df.columns if c in read[name]]) if name in read else df)

    orders = cell_orders(t["production_orders"], presses)
    t["sensors"] = kept("sensors", banded_sensors(t["cavity_shot_summary"], t["templates"]))
    t["shots"] = kept("shots", shot_jobs(shot_summary(t["sensors"]), orders, t["sensors"]))
    t["jobs"] = kept("jobs", jobs(cell_orders(orders, None, t["part_attributes"]), t["first_shot_approvals"], t["shots"], t["technicians"]))
    t["mold_events"] = kept("mold_events", mold_events(t["mold_maintenance"], t["equipment_service"], t["shots"]))
    t["lot_changes"] = lot_changes(t["material_loads"])
    head = t["shots"].select("shot_id", "press_id", "mold_id", "shot_ts", "job_id")
    t["shot_context"] = kept("shot_context", shot_context(head, t, read.get("shot_context"), lambda df: kept("shot_context", df)))
    t["chart_points"] = kept("chart_points", chart_points(t["sensors"], t["shot_context"], keep=keep, compared=compared))
    t["shot_flags"] = shot_flags(t["chart_points"])
    t["drift_state"] = kept("drift_state", drift_state(t["shots"], t["shot_context"], keep=keep))
    t["audit_pieces_linked"] = audit_pieces(t["qc_audit_pieces"], t["qc_audits"], t["shots"])
    t["shot_fact"] = kept("shot_fact", shot_fact(t))
    t["confirmed_defects"] = kept("confirmed_defects", confirmed_defects(t, t["shot_fact"]))
    t["lot_step_tests"] = kept("lot_step_tests", lot_step_tests(t["shots"], t["shot_context"]))
    t["drift_signals"] = kept("drift_signals", drift_signals(t["drift_state"], t["shot_context"], t["lot_step_tests"]))
    t["spc_alarms"] = kept("spc_alarms", chart_alarms(t["chart_points"], t["setpoint_changes"]))
    t["job_fact"] = job_fact(t["jobs"], t["shot_fact"], t["confirmed_defects"])
    t["job_hour_fact"] = job_hour_fact(t["shot_fact"], t["confirmed_defects"], t["spc_alarms"], t["drift_signals"])
    t["audit_fact"] = audit_fact(t["audit_pieces_linked"], t["part_attributes"], t["shot_fact"])
    return t
