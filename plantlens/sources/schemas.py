"""Schemas of the source systems' tables; CSV is never read with inferred types.

Fixed values: the tables' names and columns, as their systems write them.
"""

from __future__ import annotations

#: The five template values, each with a template, warning and alarm bands.
BANDED = ("fill_integral", "pack_integral", "peak_pressure_bar", "gate_seal_time_s", "end_of_fill_pressure_bar")
BANDS = ("template_value", "warning_low", "warning_high", "alarm_low", "alarm_high")
#: Patterns of free-text defect codes in the order they are tried, and the code that each stands for.
CODES = [
    ("short|non.?fill", "short_shot"),
    ("flash|flsh", "flash"),
    ("sink", "sink"),
    ("void|bubble", "void"),
    ("splay|silver", "splay"),
    ("burn|diesel", "burn"),
    ("weld|knit", "weld_line"),
    ("warp", "warp"),
    ("^dim|oot|out of tol", "dimensional"),
    ("speck|blk", "black_specks"),
    ("contam|foreign", "contamination"),
    ("gate|vestige", "gate_vestige"),
    ("^(none|ok|pass)$", "none"),
]

CSV: dict[str, str] = {
    "engineering/process_sheets": "mold_id string, press_id string, revision string, injection_velocity_mm_s double, switchover_position_mm double, hold_pressure_bar double, hold_time_s double, cooling_time_s double, melt_temp_c double, mold_temp_c double, cycle_time_s double, window_cushion_mm string, window_fill_time_pct double, window_hold_pressure_pct double, window_mold_temp_c double, window_melt_temp_c double, validated_on date",
    "erp/part_attributes": "part_id string, mold_id string, description string, customer_id string, program string, resin string, cavities bigint, nominal_weight_g double, critical_dimension_mm double, dimension_tolerance_mm double, nominal_wall_mm double, class_a_cosmetic boolean, has_weld_line boolean, flat_housing boolean, gauge_sd_weight_g double, gauge_sd_dimension_mm double, standard_cost double",
    "erp/production_orders": "work_order_id string, job_id string, part_number string, mold_id string, customer string, press_id string, quantity_ordered bigint, order_date date, scheduled_start timestamp_ntz, actual_start timestamp_ntz, resin string, program string",
    "hr/inspectors": "inspector_id string, shift string, hire_date date",
    "hr/operators": "operator_id string, shift string, hire_date date",
    "hr/technicians": "technician_id string, hire_date date, shift string",
    "materials/dryer_log": "dryer_id string, ts timestamp_ntz, setpoint_temp_c double, actual_temp_c double, dew_point_c double, hopper_level_pct double, alarm_code string",
    "materials/material_loads": "load_id string, press_id string, job_id string, load_ts timestamp_ntz, resin_lot_id string, colorant_lot_id string, regrind_pct double, dryer_id string, operator_id string",
    "materials/resin_lots": "lot_id string, resin_id string, grade string, supplier_id string, received_date date, cert_melt_flow_index double, cert_moisture_pct double, cert_density double, qty_kg bigint",
    "mes/presses": "press_id string, press_type string, tonnage bigint, install_year bigint, opc_ua boolean, cavity_pressure_unit string, cell string",
    "monitoring/templates": "template_id string, mold_id string, press_id string, sensor_id string, effective_from timestamp_ntz, established_by string, approved_by string, source_run_job_id string, template_curve_ref bigint, match_score_threshold double, band_widened boolean, reason string, " + ", ".join(f"{v}_{b} double" for v in BANDED for b in BANDS),
    "qms/customer_returns": "return_id string, customer_id string, part_id string, date_code bigint, defect_code string, qty bigint, received_date date, attributed_job_id string, attributed_cavity_id bigint",
    "qms/inspection_records": "inspection_id string, work_order_id string, inspection_date timestamp_ntz, inspector_id string, quantity_inspected bigint, quantity_passed bigint, quantity_failed bigint, defect_code_clean string, disposition string, defect_code_raw string",
    "qms/qc_audit_pieces": "audit_id string, tray_row bigint, cavity_id bigint, part_weight_g double, dimension_1 double, dimension_2 double, dimension_3 double, visual_result string, defect_codes string",
    "qms/qc_audits": "audit_id string, job_id string, press_id string, mold_id string, audit_ts timestamp_ntz, inspector_id string, sample_size bigint, sampled_shot_cycle_no double, cavity_ids_sampled string, audit_rule_violations string, disposition string",
    "qms/scrap_events": "scrap_id string, work_order_id string, press_id string, scrap_date date, defect_code string, quantity_scrapped bigint, unit_cost double, material_cost double, labor_cost double, total_scrap_cost double",
    "qms/scrap_tallies": "tally_id string, job_id string, press_id string, shift_date date, shift string, cavity_id double, defect_code string, qty bigint, hour_bucket bigint, entered_by string, entered_ts timestamp_ntz",
    "qms/setpoint_changes": "change_id string, press_id string, job_id string, change_ts timestamp_ntz, parameter string, old_value double, new_value double, technician_id string, reason_code string, approved_by string",
    "qms/sort_dispositions": "review_id string, review_mode string, shot_id bigint, job_id string, press_id string, mold_id string, shift_date date, shift string, reviewed_ts timestamp_ntz, inspector_id string, sorted_shots bigint, pieces_reviewed bigint, pieces_confirmed_defective bigint, defect_codes string, pieces_good bigint",
    "toolroom/equipment_service": "press_id string, equipment string, event_ts timestamp_ntz, event_type string",
    "toolroom/mold_maintenance": "mold_id string, event_ts timestamp_ntz, event_type string, shots_at_event double, technician_id string, notes string",
    "seeds/resin_grades": "resin_id string, mfi_nominal double, mfi_band_low double, mfi_band_high double, hygroscopic boolean, min_residence_h double",
}
#: The seed tables' rows.
SEEDS = {
    "resin_grades": [
        ("PA66 GF30", 12.0, 9.0, 15.0, True, 4.0),
        ("PC/ABS", 18.0, 14.0, 22.0, True, 3.0),
        ("POM", 9.0, 7.5, 10.5, False, 0.0),
        ("PP copolymer", 20.0, 16.0, 24.0, False, 0.0),
    ]
}
#: Written as text throughout; staged with casts that turn what doesn't parse into null.
TEXT_CSV: dict[str, tuple[str, ...]] = {
    "qms/first_shot_approvals": ("job_id", "press_id", "mold_id", "approval_ts", "technician_id", "inspector_id", "shots_to_approval", "part_weight_g", "dimension_values", "visual_result", "approved", "template_id_established"),
}
#: Parquet tables and what they are partitioned by.
PARQUET: dict[str, tuple[str, ...]] = {
    "monitoring/cavity_shot_summary": ("month",),
    "monitoring/cavity_curves": ("month", "mold"),
    "mes/machine_shot_data": ("month",),
}
