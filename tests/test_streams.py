"""Streams against the batch replays of the same rows."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from terravote.operators import state
from terravote.plans import replaying
from terravote.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The call log in four files, in order of time, so that the stream reads it in four batches."""
    path = str(tmp_path_factory.mktemp("calls"))
    t = replaying.calls(spark, SF).orderBy("ts").limit(240)
    rows = t.collect()
    for i in range(4):
        spark.createDataFrame(rows[60 * i : 60 * i + 60], t.schema).coalesce(1).write.mode("append").parquet(path)
    return path, t


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return Counter(map(str, spark.table(name).collect()))


def test_gate_and_quota(spark, events):
    path, t = events
    stream = lambda: spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(spark, stateful.spend_gate(stream(), 0.2, 1.0), "gate")
    assert got == Counter(map(str, state.spend_gate(spark.createDataFrame(t.collect(), t.schema), 0.2, 1.0).collect()))
    got = drain(spark, stateful.quota_admission(stream(), 2), "quota")
    assert got == Counter(map(str, state.quota_admission(spark.createDataFrame(t.collect(), t.schema), 2).collect()))


LOG = "catalogue_id string, seq long, op string, name string, ts timestamp"


def _log_files(spark, tmp_path, files):
    for i, rows in enumerate(files):
        spark.createDataFrame([(c, s, o, n, datetime(2024, 1, 1) + timedelta(minutes=m)) for c, s, o, n, m in rows], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def test_expiries_need_no_event_of_their_catalogue(spark, tmp_path):
    big = (1 << 60) + 1
    files = [[("a", big, "register", "Oslo", 0), ("a", None, "register", "Bergen", 5), ("b", big + 2, "register", "Rome", 10)], [("b", 4, "register", "Rome", 50)], [("b", 5, "register", "Turin", 200)], [("b", 6, "register", "Bari", 500)]]
    stream = _log_files(spark, tmp_path, files)
    q = stateful.catalogue_changes(stream, 3600, 20, late="0 minutes").writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = Counter(map(str, spark.table("changes").collect()))
    batch = state.catalogue_changes(spark.createDataFrame([(c, s, o, n, datetime(2024, 1, 1) + timedelta(minutes=m)) for f in files for c, s, o, n, m in f], LOG), 3600, 20, until=datetime(2024, 1, 1, 8, 20))
    assert got == Counter(map(str, batch.collect()))
    rows = spark.table("changes").collect()
    assert {(r.name, (r.at - 1704067200) / 60) for r in rows if r.status == "expired"} == {("Oslo", 60), ("Bergen", 65), ("Rome", 110), ("Turin", 260)}
    assert {r.seq for r in rows if r.status != "expired"} == {big, None, big + 2, 4, 5, 6}
    kept = spark.read.format("statestore").option("stateVarName", "added").load(str(tmp_path / "state")).select("key.catalogue_id").distinct().collect()
    assert [r.catalogue_id for r in kept] == ["b"]  # an idle catalogue holds nothing


def test_idle_keys_hold_no_state(spark, tmp_path):
    kind = "call_id long, kind string, key string, ts timestamp, usd double, paid boolean"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    files = [[(1, "s", "idle", at(0), 1.0, True), (2, "s", "busy", at(0), 1.0, True)], [(3, "s", "busy", at(20), 0.5, True)], [(None, "s", "busy", at(30), 0.5, True)], [(5, "s", "busy", at(31), None, None)]]
    for rows in files:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    whole = spark.createDataFrame([r for f in files for r in f], kind)
    for name, stream, batch in (("gate", lambda t: stateful.spend_gate(t, 0.2, 1.2, late="0 minutes"), state.spend_gate(whole, 0.2, 1.2)), ("quota", lambda t: stateful.quota_admission(t, 2, late="0 minutes"), state.quota_admission(whole, 2))):
        t = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
        q = stream(t).writeStream.format("memory").queryName(f"idle_{name}").option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert Counter(map(str, spark.table(f"idle_{name}").collect())) == Counter(map(str, batch.collect()))
        kept = spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / name)).select("key.key").distinct().collect()
        assert [r.key for r in kept] == ["busy"]


def test_replays_keep_long_ids_and_null_keys(spark):
    kind = "call_id long, kind string, key string, ts timestamp, usd double, paid boolean"
    ids = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 62) + 1]
    rows = [(i, "s", k, datetime(2024, 1, 1, 0, n), 0.1, True) for k in ("a", None) for n, i in enumerate(ids)] + [(9, "s", "a", None, 0.1, True)]
    t = spark.createDataFrame(rows, kind)
    for out in (state.spend_gate(t, 1.0, 2.0), state.quota_admission(t, 3)):
        got = out.collect()
        assert Counter((r.call_id, r.key) for r in got) == Counter((r[0], r[2]) for r in rows)
    assert state.spend_gate(t.limit(0), 1.0, 2.0).count() == 0


def test_replays_match_one_key_at_a_time(spark):
    r = random.Random(2)
    kind = "call_id long, key string, ts timestamp, usd double, paid boolean"
    rows = [(i, "hot" if r.random() < 0.5 else f"k{r.randrange(20)}", datetime(2024, 1, 1) + timedelta(seconds=r.randrange(200_000)), r.random() / 10, r.random() < 0.8) for i in range(3000)]
    want = {}
    for key in {x[1] for x in rows}:
        led = state.Ledger(0.2, 1.0)
        for i, _, ts, usd, paid in sorted((x for x in rows if x[1] == key), key=lambda x: (x[2], x[0])):
            want[i] = led.offer((ts - datetime(1970, 1, 1)).total_seconds(), usd, paid)
    got = {x.call_id: (x.ran, x.hour, x.day) for x in state.spend_gate(spark.createDataFrame(rows, kind).repartition(7), 0.2, 1.0).collect()}
    assert got == want


def test_hourly_spend_runs(spark, events):
    path, t = events
    s = spark.readStream.schema(t.schema).parquet(path)
    assert drain(spark, stateful.hourly_spend(s, step="1 hour"), "hourly", "complete")


def test_scoring_a_stream(spark):
    assert replaying.stream_scoring(spark, SF).count() == 200
