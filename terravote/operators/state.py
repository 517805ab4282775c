"""Windows over a call log, and replays of rules whose decisions feed back: batch forms.

A replay is a scan of one key's events in order: rows are shuffled and sorted by key and time, and a task reads them on
and on, in Arrow batches, holding the state of the one key that it is at.  However many rows a key has, its replay holds
no more than the rule's window: an hour's or a day's entries, or the names that a catalogue holds.  Streaming forms of the
same steps are in terravote.streaming.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HOUR, DAY = 3600.0, 86400.0


def rolling_spend(calls: DataFrame, hour_cap: float = 0.0, day_cap: float = 0.0) -> DataFrame:
    """Adds hour, day and reached (which cap the key has met, the hour's first; a cap of 0 is off) to every call.

    Both windows include their far end.  Amounts of 0 or less don't count.
    """
    t = calls.withColumn("__at", F.unix_micros("ts")).withColumn("__usd", F.greatest("usd", F.lit(0.0)))
    over = lambda s: Window.partitionBy("key").orderBy("__at").rangeBetween(-int(s * 1e6), 0)
    t = t.withColumn("hour", F.sum("__usd").over(over(HOUR))).withColumn("day", F.sum("__usd").over(over(DAY)))
    reached = F.when(F.lit(hour_cap > 0) & (F.col("hour") >= hour_cap), "hour").when(F.lit(day_cap > 0) & (F.col("day") >= day_cap), "day")
    return t.withColumn("reached", reached).drop("__at", "__usd")


class Ledger:
    """Spend of one key so far; a paid call is let through unless a cap is met, and only then costs.

    Two running sums move with their windows, so a call costs what leaves them.  They are kept as exact fractions of
    1 / 2**60, which sums and differences don't wear.
    """

    UNIT = 2.0**60

    def __init__(self, hour_cap: float, day_cap: float, entries=()):
        self.hour_cap, self.day_cap, self.entries, self.late = hour_cap, day_cap, deque(), deque()
        self.hour = self.day = 0
        for at, usd in entries:
            self._add(at, usd)

    def _add(self, at: float, usd: float) -> None:
        n = int(usd * self.UNIT)
        self.entries.append((at, usd))
        self.late.append((at, n))
        self.day, self.hour = self.day + n, self.hour + n

    def offer(self, at: float, usd: float, paid: bool) -> tuple[bool, float, float]:
        while self.entries and self.entries[0][0] < at - DAY:
            self.day -= int(self.entries.popleft()[1] * self.UNIT)
        while self.late and self.late[0][0] < at - HOUR:
            self.hour -= self.late.popleft()[1]
        hour, day = self.hour / self.UNIT, self.day / self.UNIT
        full = 0 < self.hour_cap <= hour or 0 < self.day_cap <= day
        run = not (paid and full)
        if run and usd > 0:
            self._add(at, usd)
        return run, hour, day


class Quota:
    """Calls of one key admitted within the last hour; a refused call takes no place."""

    def __init__(self, limit: int, entries=()):
        self.limit, self.entries = limit, deque(entries)

    def offer(self, at: float) -> tuple[bool, int, float]:
        while self.entries and self.entries[0] <= at - HOUR:
            self.entries.popleft()
        if len(self.entries) < self.limit:
            self.entries.append(at)
            return True, self.limit - len(self.entries), 0.0
        return False, 0, self.entries[0] + HOUR - at if self.entries else HOUR


class Catalogue:
    """Onboarded names of one catalogue and when each was added: expiry, a cap with the oldest going first, reset."""

    def __init__(self, ttl_s: float, cap: int, builtin=frozenset(), added=None):
        self.ttl, self.cap, self.builtin, self.added = ttl_s, cap, builtin, dict(added or {})

    def expire(self, now: float) -> list[tuple[str, float]]:
        """Names whose time is over, with that time, in its order."""
        gone = sorted(((n, t + self.ttl) for n, t in self.added.items() if self.ttl > 0 and t <= now - self.ttl), key=lambda x: x[1])
        for n, _ in gone:
            del self.added[n]
        return gone

    def expiries(self, catalogue_id, now: float) -> list[tuple]:
        """The same as rows of changes: each with how many names it left."""
        gone = self.expire(now)
        return [(catalogue_id, None, n, "expired", len(self.added) + len(gone) - k, [], t) for k, (n, t) in enumerate(gone, 1)]

    def apply(self, op: str, name: str, now: float) -> tuple[str, list[str]]:
        """status and evicted names of a register or reset, after what has expired is gone."""
        if op == "reset":
            if name in self.added:
                del self.added[name]
                return ("built_in_restored" if name in self.builtin else "removed"), []
            return "not_present", []
        status = "already_present" if name in self.added else "added"
        self.added.pop(name, None)
        evicted = []
        if name not in self.builtin and self.cap > 0:
            own = [n for n in self.added if n not in self.builtin]
            while len(own) >= self.cap:
                evicted.append(own.pop(0))
                del self.added[evicted[-1]]
        self.added[name] = now
        return status, evicted


def _replayed(events: DataFrame, keys: list[str], columns: list[str], make: Callable, step: Callable, schema: str, end: Callable = lambda key, book: ()) -> DataFrame:
    """Replays of every key's events, in the order of ts and then of the first of ``columns``.

    ``make()`` gives a key's state, ``step(state, key, time, *columns)`` the rows of an event, ``end(key, state)`` those after a
    key's last event.  Null keys are a key like any other, ids pass through as they are, and events without a time come
    first, before all time.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    k = len(keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], schema=kinds)

        key, book = None, None
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                now, at, rest = row[:k], row[k], row[k + 1 :]
                if book is None or now != key:
                    if book is not None:
                        rows += end(key, book)
                    key, book = now, make()
                rows += step(book, key, float("-inf") if at is None else at / 1e6, *rest)
            yield out(rows)
        if book is not None:
            yield out(list(end(key, book)))

    t = events.select(*keys, F.unix_micros("ts").alias("__at"), *columns)
    assert t.columns[:k] == keys
    return t.repartition(*keys).sortWithinPartitions(*keys, "__at", columns[0]).mapInArrow(run, schema)


def spend_gate(calls: DataFrame, hour_cap: float, day_cap: float) -> DataFrame:
    """calls (call_id, key, ts, usd, paid) -> call_id, key, ran, hour, day: totals before the call.

    A null amount is none, a null paid is false.
    """

    def step(ledger, key, at, call_id, usd, paid):
        return [(call_id, key[0], *ledger.offer(at, usd or 0.0, bool(paid)))]

    return _replayed(calls, ["key"], ["call_id", "usd", "paid"], lambda: Ledger(hour_cap, day_cap), step, f"call_id long, key {dict(calls.dtypes)['key']}, ran boolean, hour double, day double")


def quota_admission(calls: DataFrame, limit: int) -> DataFrame:
    """calls (call_id, kind, key, ts) -> call_id, kind, key, admitted, remaining, retry_after in seconds."""
    kinds = dict(calls.dtypes)

    def step(quota, key, at, call_id):
        return [(call_id, *key, *quota.offer(at))]

    return _replayed(calls, ["kind", "key"], ["call_id"], lambda: Quota(limit), step, f"call_id long, kind {kinds['kind']}, key {kinds['key']}, admitted boolean, remaining int, retry_after double")


CHANGES = "seq long, name string, status string, size int, evicted array<string>, at double"


def catalogue_changes(log: DataFrame, ttl_s: float = 3600.0, cap: int = 20, builtin: frozenset = frozenset(), until: datetime | None = None) -> DataFrame:
    """log (catalogue_id, seq, op, name, ts) -> catalogue_id, seq, name, status, size, evicted, at; expiries have seq null.

    Expiries up to ``until`` (UTC if it has no zone) come out also after a catalogue's last event; without it they end there.
    """
    last = None if until is None else (until if until.tzinfo else until.replace(tzinfo=timezone.utc)).timestamp()

    def step(book, key, at, seq, op, name):
        gone = book.expiries(key[0], at)
        status, evicted = book.apply(op, name, at)
        return [*gone, (key[0], seq, name, status, len(book.added), evicted, at)]

    end = (lambda key, book: ()) if last is None else (lambda key, book: book.expiries(key[0], last))
    return _replayed(log, ["catalogue_id"], ["seq", "op", "name"], lambda: Catalogue(ttl_s, cap, builtin), step, f"catalogue_id {dict(log.dtypes)['catalogue_id']}, {CHANGES}", end)


def catalogue_history(changes: DataFrame) -> DataFrame:
    """(catalogue_id, name, valid_from, valid_to) from catalogue_changes: intervals in which a name was present."""
    seq = F.col("seq").cast("double")
    start = changes.filter(F.col("status").isin("added", "already_present")).select("catalogue_id", "name", "at", seq.alias("o"), F.lit(True).alias("on"))
    stop = changes.filter(F.col("status").isin("removed", "expired", "built_in_restored")).select("catalogue_id", "name", "at", F.coalesce(seq, F.lit(-1.0)).alias("o"), F.lit(False).alias("on"))
    gone = changes.select("catalogue_id", F.explode("evicted").alias("name"), "at", seq.alias("o")).withColumn("on", F.lit(False))
    by = Window.partitionBy("catalogue_id", "name").orderBy("at", "o", "on")
    t = start.unionByName(stop).unionByName(gone).withColumn("valid_to", F.lead("at").over(by))
    return t.filter("on").select("catalogue_id", "name", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("valid_from"), F.timestamp_micros((F.col("valid_to") * 1e6).cast("long")).alias("valid_to"))
