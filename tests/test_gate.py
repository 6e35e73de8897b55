"""The control gate: one reason a breach, repeats, the kill switch, and the stream against the batch."""

import datetime as dt

from panelwright.streaming import gate

NOW = dt.datetime(2024, 1, 10)
SCHEMA = "portfolio long, seq long, kind string, decision_id string, decision_time timestamp_ntz, data_available_at timestamp_ntz, target_weights map<string, double>, current_weights map<string, double>, equity double, previous_equity double"


def row(seq, id_, kind="decision", target=None, equity=100.0, previous=100.0, age=1, portfolio=1):
    return (portfolio, seq, kind, id_, NOW, NOW - dt.timedelta(hours=age), target if target is not None else {"A": 0.05}, {"A": 0.05}, equity, previous)


ROWS = [
    row(1, "a"), row(2, "a"), row(3, "b", target={"A": 0.3}), row(4, "c", age=200), row(5, "d", age=-1), row(6, "e", equity=80.0, previous=80.0), row(7, "f", equity=90.0), row(8, "g", equity=-1.0),
    row(1, "a", portfolio=2),
]
WANT = {(1, 1): [], (1, 2): ["duplicate_decision_id"], (1, 3): ["position_limit"], (1, 4): ["stale_data"], (1, 5): ["future_data_availability"], (1, 6): ["drawdown_limit"], (1, 7): ["daily_loss_limit"], (1, 8): ["invalid_input"], (2, 1): []}


def test_batch(spark):
    got = {(r.portfolio, r.seq): list(r.reasons) for r in gate.batch_gate(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == WANT


def test_observed_values(spark):
    rows = gate.batch_gate(spark.createDataFrame(ROWS, SCHEMA)).collect()
    got = {(r.portfolio, r.seq): r.observed for r in rows}
    assert got[1, 2] == {} and got[1, 8] == {} and set(got[1, 6]) == set(gate.OBSERVED)
    six = got[1, 6]
    assert abs(six["drawdown"] + 0.2) < 1e-12 and six["gross_exposure"] == 0.05 and six["turnover"] == 0 and six["notional"] == 4 and six["data_age_seconds"] == 3600 and six["daily_return"] == 0


def run(spark, stream, tmp_path, **options):
    q = gate.stream_gate(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_stream_equals_batch(spark, tmp_path):
    kill = row(9, None, kind="kill")
    spark.createDataFrame([*ROWS, kill, row(10, "h")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = run(spark, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), tmp_path)
    got = {(r.portfolio, r.seq): list(r.reasons) for r in rows}
    assert got == WANT | {(1, 10): ["manual_kill_switch"]}
    batch = {(r.portfolio, r.seq): r.observed for r in gate.batch_gate(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert all(set(r.observed) == set(batch[r.portfolio, r.seq]) and all(abs(v - batch[r.portfolio, r.seq][k]) < 1e-9 for k, v in r.observed.items()) for r in rows if r.seq < 10)


def test_expired_ids_stream_equals_batch(spark, tmp_path):
    """Repeats within, and after, the time to live of three days, over several batches; one decision comes later than the watermark."""
    day = lambda n: NOW + dt.timedelta(days=n)
    at = lambda seq, id_, n, portfolio=1: (portfolio, seq, "decision", id_, day(n), day(n), {"A": 0.05}, {"A": 0.05}, 100.0, 100.0)
    files = [[at(1, "a", 0), at(2, "b", 0), at(1, "a", 0, 2)], [at(3, "a", 2), at(4, "c", 10)], [at(5, "a", 11), at(6, "b", 10), at(2, "a", 12, 2), at(7, "c", 12)], [at(8, "late", 5), at(9, "a", 13.9)], [at(10, "d", 30)], [at(11, "a", 31), at(12, "d", 32)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.portfolio, r.seq): list(r.reasons) for r in run(spark, stream, tmp_path, ttl_days=3)}
    kept = [r for rows in files for r in rows if r[3] != "late"]
    batch = gate.batch_gate(spark.createDataFrame(kept, SCHEMA), ttl_days=3)
    assert got == {(r.portfolio, r.seq): list(r.reasons) for r in batch.collect()}
    assert {k for k, v in got.items() if v} == {(1, 3), (1, 7), (1, 9), (1, 12)}
