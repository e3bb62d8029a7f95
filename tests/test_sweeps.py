"""Sweeps hold every arm, device and shape of their survey rows."""

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_anomaly_shapes(spark):
    rows = entry.queries()["m29_anomaly_shapes"](spark, SMALL).collect()
    assert len({r["shape"] for r in rows}) == len(rows) == 8
    assert len({(r.clean_detections, r.clean_residual_kwh) for r in rows}) == 1 and rows[0].clean_residual_kwh >= 0
    assert all(0 <= r.detected <= r.houses for r in rows)


def test_estimator_sweep_has_all_devices(spark):
    rows = entry.queries()["m39_estimator_sweep"](spark, SMALL).collect()
    devices = {r.event_type for r in spark.read.parquet(f"{SMALL}/events.parquet").select("event_type").distinct().collect()}
    assert {r.device for r in rows} == devices and {r.k for r in rows} == {1, 3, 10}
    assert all(r.f1_mean is None or 0 <= r.f1_mean <= 1 for r in rows) and any(r.f1_mean is not None for r in rows)


def test_k_curve_has_three_arms(spark):
    rows = entry.queries()["m20_k_curve"](spark, SMALL).collect()
    assert {r.arm for r in rows} == {"anchor", "sessions", "em"}
    assert {(r.cadence_s, r.k) for r in rows if r.arm == "em"} == {(600, 0), (3600, 0)}
