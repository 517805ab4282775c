"""Streaming forms: rolling sums with watermarks, admission and catalogue replays with state, and live scoring.

The stateful steps use the same classes as the batch replays, so that a stream and a replay of the same rows agree.  State
is kept per key in lists and maps; a timer on event time, one per key, stands at the moment from which the rule forgets:
then a catalogue's expiries come out, without an event of the key, and an idle key's state goes.  Rows later than the
watermark are dropped.  The RocksDB state store is needed: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terravote.operators.state import CHANGES, DAY, HOUR, Catalogue, Ledger, Quota
from terravote.operators.toponyms import gazetteer_in_row
from terravote.sources.shared import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hourly_spend(calls: DataFrame, late: str = "10 minutes", step: str = "1 minute") -> DataFrame:
    """Sums of a stream of calls per key over sliding hours."""
    paid = calls.filter(F.col("usd") > 0).withWatermark("ts", late)
    return paid.groupBy(F.window("ts", "1 hour", step), "key").agg(F.sum("usd").alias("usd"), F.count("*").alias("calls"))


class _Replay(StatefulProcessor):
    """One key's replay; subclasses say how state is read, stepped, stored, and when a timer is due."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(at=pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, number=pd.to_numeric(pdf[self.order]))
        book = self.load()
        out = self.step(book, pdf.sort_values(["at", "number"], kind="stable"))
        self._keep(book)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        book = self.load()
        out = self.pass_time(key, book, timerValues.getCurrentWatermarkInMs() / 1000)
        self._keep(book)
        if out is not None:
            yield out

    def _keep(self, book) -> None:
        """Stores the state, or drops it, and sets the key's one timer anew."""
        self.store(book)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if (due := self.due(book)) is not None:
            self.handle.registerTimer(math.ceil(due * 1000) + 1)

    def close(self) -> None:
        pass


class _Entries(_Replay):
    """State in a list; when the last entry is out of the window, all of it goes."""

    order = "call_id"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("entries", self.fields)

    def held(self) -> list[tuple]:
        return [tuple(r) for r in self.kept.get()] if self.kept.exists() else []

    def store(self, book) -> None:
        if book.entries:
            self.kept.put([x if isinstance(x, tuple) else (x,) for x in book.entries])
        else:
            self.kept.clear()

    def pass_time(self, key, book, now):
        while book.entries and self.time(book.entries[0]) + self.window < now:
            book.entries.popleft()

    def due(self, book):
        return self.time(book.entries[-1]) + self.window if book.entries else None


class _Gate(_Entries):
    fields, window = "at double, usd double", DAY

    def __init__(self, hour_cap: float, day_cap: float):
        self.hour_cap, self.day_cap = hour_cap, day_cap

    def load(self):
        return Ledger(self.hour_cap, self.day_cap, self.held())

    def time(self, entry):
        return entry[0]

    def step(self, book, pdf):
        out = [book.offer(a, 0.0 if pd.isna(u) else u, p is not None and bool(p)) for a, u, p in zip(pdf["at"], pdf["usd"], pdf["paid"])]
        return pd.DataFrame({"call_id": pdf["call_id"].to_numpy(), "key": pdf["key"].to_numpy()} | {n: [o[i] for o in out] for i, n in enumerate(("ran", "hour", "day"))})


class _Admission(_Entries):
    fields, window = "at double", HOUR

    def __init__(self, limit: int):
        self.limit = limit

    def load(self):
        return Quota(self.limit, [x[0] for x in self.held()])

    def time(self, entry):
        return entry

    def step(self, book, pdf):
        out = [book.offer(a) for a in pdf["at"]]
        return pd.DataFrame({c: pdf[c].to_numpy() for c in ("call_id", "kind", "key")} | {n: [o[i] for o in out] for i, n in enumerate(("admitted", "remaining", "retry_after"))})


class _Lifecycle(_Replay):
    """Names in a map, with the time and the place at which each was added."""

    order = "seq"

    def __init__(self, ttl_s: float, cap: int, builtin: frozenset):
        self.ttl_s, self.cap, self.builtin = ttl_s, cap, builtin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getMapState("added", "name string", "at double, place long")

    def load(self):
        found = sorted(((v[1], k[0], v[0]) for k, v in self.kept.iterator()) if self.kept.exists() else ())
        self.before = {n: (t, p) for p, n, t in found}
        return Catalogue(self.ttl_s, self.cap, self.builtin, {n: t for _, n, t in found})

    def store(self, book) -> None:
        now = {n: (t, p) for p, (n, t) in enumerate(book.added.items())}
        for n in self.before.keys() - now.keys():
            self.kept.removeKey((n,))
        for n, v in now.items():
            if self.before.get(n) != v:
                self.kept.updateValue((n,), v)

    def due(self, book):
        return min(book.added.values()) + self.ttl_s if book.added and self.ttl_s > 0 else None

    def _rows(self, rows) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["catalogue_id", "seq", "name", "status", "size", "evicted", "at"])
        return out.astype({"seq": object, "size": "int32", "at": "float64"})

    def pass_time(self, key, book, now):
        gone = book.expiries(key[0], now)
        return self._rows(gone) if gone else None

    def step(self, book, pdf):
        out = []
        for cid, seq, op, name, a in zip(pdf["catalogue_id"], pdf["seq"], pdf["op"], pdf["name"], pdf["at"]):
            out += book.expiries(cid, a)
            status, evicted = book.apply(op, name, a)
            out.append((cid, seq, name, status, len(book.added), evicted, a))
        return self._rows(out)


def _run(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, number: str, late: str) -> DataFrame:
    """Numbers of rows go through as text, as pandas would make them floats beside a null."""
    t = stream.withWatermark("ts", late).withColumn(number, F.col(number).cast("string"))
    names = [f.split(" ")[0] for f in schema.replace("array<string>", "x").split(", ")]
    out = t.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema.replace(f"{number} long", f"{number} string"), outputMode="Append", timeMode="EventTime")
    return out.select(*(F.col(n).cast("long").alias(n) if n == number else n for n in names))


def spend_gate(calls: DataFrame, hour_cap: float, day_cap: float, late: str = "10 minutes") -> DataFrame:
    """state.spend_gate on a stream.  A key idle for a day holds nothing."""
    return _run(calls.select("call_id", "key", "ts", "usd", "paid"), ["key"], _Gate(hour_cap, day_cap), f"call_id long, key {dict(calls.dtypes)['key']}, ran boolean, hour double, day double", "call_id", late)


def quota_admission(calls: DataFrame, limit: int, late: str = "10 minutes") -> DataFrame:
    """state.quota_admission on a stream.  A key idle for an hour holds nothing."""
    kinds = dict(calls.dtypes)
    return _run(calls.select("call_id", "kind", "key", "ts"), ["kind", "key"], _Admission(limit), f"call_id long, kind {kinds['kind']}, key {kinds['key']}, admitted boolean, remaining int, retry_after double", "call_id", late)


def catalogue_changes(log: DataFrame, ttl_s: float = 3600.0, cap: int = 20, builtin: frozenset = frozenset(), late: str = "10 minutes") -> DataFrame:
    """state.catalogue_changes on a stream.  Expiries come out as the watermark passes their time."""
    return _run(log.select("catalogue_id", "seq", "op", "name", "ts"), ["catalogue_id"], _Lifecycle(ttl_s, cap, builtin), f"catalogue_id {dict(log.dtypes)['catalogue_id']}, {CHANGES}", "seq", late)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source is read up, written batch by batch to the shared folder and read back."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def score_posts(posts: DataFrame, places: list[str], k: int = 5) -> DataFrame:
    """Live gazetteer scoring of a stream of posts (row_id, text): within the row, so no state is held."""
    return gazetteer_in_row(posts, places, k)
