"""State on a live log: stopped and started again, records that come twice, and the same answer as at rest."""

import itertools

import pytest
from pyspark.sql import functions as F

from strataloom.operators import series
from strataloom.streaming import findings

SCANS = {"a": ["xy", "x", "xy", "", "xyz", "z", "x"], "b": ["q", "q", "q"], "c": ["", "", "p"]}


@pytest.fixture
def log(spark, tmp_path):
    """Appends scans to a log in turns and follows it as a stream that goes on each time."""
    folder, base, schema = f"file://{tmp_path}/log", f"file://{tmp_path}/stream", "series string, scan long, findings array<string>"

    def turn(records):
        spark.createDataFrame(records, schema).coalesce(1).write.mode("append").parquet(folder)
        return findings.presence(spark.readStream.schema(schema).parquet(folder), base)

    return turn


def test_presence_goes_on_over_turns_and_equals_the_batch(spark, log):
    records = [(s, n, sorted(set(x))) for s, own in SCANS.items() for n, x in enumerate(own, 1)]
    turns = [[r for r in records if r[1] <= 2], [r for r in records if 3 <= r[1] <= 4] + [r for r in records if r[1] == 2], [r for r in records if r[1] > 4]]
    for k, turn in enumerate(turns):
        found = log(turn)
        so_far = {(r[0], r[1]): r for r in itertools.chain(*turns[: k + 1])}.values()
        scans = spark.createDataFrame([r[:2] for r in so_far], "series string, scan long")
        here = spark.createDataFrame([(r[0], r[1], f) for r in so_far for f in r[2]], "series string, scan long, finding string")
        want = series.recurrence(here, scans, ["series"], "scan", "finding")
        got = findings.live_recurrence(found, scans.groupBy("series").agg(F.max("scan").alias("last")))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    ends = scans.groupBy("series").agg(F.max("scan").alias("last"))
    assert sorted(tuple(r) for r in findings.live_recurrence(found, ends, returns=2).select("series", "finding", "returned").collect()) == [("a", "x", 2), ("a", "y", 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")  # the session's own setting is back


def test_latest_keeps_the_last_two_records(spark, tmp_path):
    folder, base, schema = f"file://{tmp_path}/log", f"file://{tmp_path}/stream", "series string, name string, place string, value double"
    turns = [[("s", "n", "03", 5.0), ("s", "n", "01", 9.0), ("t", "n", "01", 1.0)], [("s", "n", "02", 0.0), ("s", "n", "04", 4.0), ("t", "n", "02", None)], [("t", "n", "03", 0.5)]]
    for turn in turns:
        spark.createDataFrame(turn, schema).coalesce(1).write.mode("append").parquet(folder)
        got = findings.latest(spark.readStream.schema(schema).parquet(folder), base)
    assert sorted(map(tuple, got.select("series", "name", "place", "before", "value", "records").collect())) == [("s", "n", "04", 5.0, 4.0, 3), ("t", "n", "03", None, 0.5, 3)]
    assert [tuple(r) for r in findings.live_ratchet(got, 0.5).collect()] == [("s", "n", 5.0, 4.0)]


def test_states_are_tables_and_no_key_is_worked_on_by_itself(spark, tmp_path):
    folder, base = f"file://{tmp_path}/log", f"file://{tmp_path}/base"
    for turn in range(2):
        spark.range(500).selectExpr("cast(id as string) series", f"cast({turn} + 1 as long) scan", "array('x', 'y') findings").write.mode("append").parquet(folder)
        found = findings.presence(spark.readStream.schema("series string, scan long, findings array<string>").parquet(folder), base)
        assert {tuple(r) for r in found.select("seen", "last", "returned").collect()} == {(turn + 1, turn + 1, 0)}
    assert found.count() == 1000
    assert not (tmp_path / "base" / "state" / "state").exists()
