"""Keyed state for streams: what the batch jobs do with window functions.

Every processor acts in the order of event time: rows are held until the watermark has passed them, so that none can come between
them any more, and are released by timers. Results keep their event time and a watermark on it, so that further stateful
steps and windows can follow in the same query. State that a day needs ends with the day, by event time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Streams with these states need this provider (spark.sql.streaming.stateStore.providerClass).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sort_key(row: dict[str, Any], by: list[str]) -> tuple:
    """Nulls first."""
    return tuple((row[c] is not None, row[c]) for c in by)


def _rows(batches: Iterator[pd.DataFrame], columns: list[str], whole: set[str]) -> list[dict[str, Any]]:
    """A micro-batch's rows of one key; a key's rows of one batch only. ``whole`` are the columns of integers, which are floats beside nulls."""

    def plain(c: str, value: Any) -> Any:
        value = _plain(value)
        return int(value) if c in whole and value is not None else value

    return [{c: plain(c, v) for c, v in r.items()} for part in batches for r in part[columns].to_dict("records")]


def _whole(kinds: str) -> set[str]:
    """The integer columns of what ``_kinds`` gives."""
    return set(re.findall(r"`([^`]*)` (?:tinyint|smallint|int|bigint)(?:,|$)", kinds))


class InOrder(StatefulProcessor):
    """Holds rows (``columns``, with ``at_us``, their time in microseconds) until the watermark has passed them; then ``take`` gets them by time and ``tie``."""

    def __init__(self, columns: list[str], kinds: str, out: list[str], time: str, tie: list[str] | None = None):
        self.columns, self.kinds, self.out, self.time, self.by = columns, kinds, out, time, ["at_us", *(tie or [])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", self.kinds)

    def take(self, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """What these rows of the key give; the rows come after all that came before."""
        raise NotImplementedError

    def expire(self, passed: int) -> None:
        """Drop state that rows after the watermark, in milliseconds, do not need."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = _rows(rows, self.columns, _whole(self.kinds))
        if found:
            self.held.appendList([tuple(r[c] for c in self.columns) for r in found])
            self.wake({r["at_us"] for r in found})
        return iter(())

    def wake(self, times: set[int]) -> None:
        """Timers of the milliseconds before: one expires once the watermark is behind it, when the row is passed."""
        for ms in {-(-us // 1000) - 1 for us in times}:
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = int(timerValues.getCurrentWatermarkInMs())
        held = [dict(zip(self.columns, r, strict=True)) for r in self.held.get()]
        due = [r for r in held if r["at_us"] <= 1000 * passed]
        if due:
            keep = [r for r in held if r["at_us"] > 1000 * passed]
            self.held.clear()
            if keep:
                self.held.put([tuple(r[c] for c in self.columns) for r in keep])
            found = self.take(sorted(due, key=lambda r: _sort_key(r, self.by)))
            if found:
                yield self.result(found)
        self.expire(passed)

    def result(self, rows: list[dict[str, Any]]) -> pd.DataFrame:
        done = pd.DataFrame(rows)
        done[self.time] = pd.to_datetime(done["at_us"], unit="us", utc=True)
        return done[self.out]

    def close(self) -> None:
        pass


class FirstPerDay(InOrder):
    """A key's first row of each day; the last day is remembered until the watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "day string, until long")

    def take(self, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        last, until = self.last.get() if self.last.exists() else ("", 0)
        out = []
        for row in rows:
            if row["day"] > last:
                last, until = row["day"], row["day_end"]
                out.append(row)
        if out:
            self.last.update((last, until))
            self.handle.registerTimer(until)
        return out

    def expire(self, passed: int) -> None:
        if self.last.exists() and self.last.get()[1] <= passed:
            self.last.clear()


class UserFlags(InOrder):
    """Every row with ``unique`` (first of the key's day) and ``new`` (first ever), 0 or 1; state without end: the last day. Rows without a user have neither."""

    def __init__(self, columns: list[str], kinds: str, out: list[str], time: str, tie: list[str] | None, user: str, unique: str, new: str):
        super().__init__(columns, kinds, out, time, tie)
        self.user, self.unique, self.new = user, unique, new

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "day string")

    def take(self, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        before = last = str(self.last.get()[0]) if self.last.exists() else ""
        out = []
        for row in rows:
            known = row[self.user] is not None
            out.append(row | {self.unique: int(known and row["day"] > last), self.new: int(known and last == "")})
            last = max(last, row["day"]) if known else last
        if last != before:
            self.last.update((last,))
        return out


class Logins(InOrder):
    """A user's first login of each day with ``uu_ct`` 1 and ``back_ct``; state without end: the last day."""

    def __init__(self, columns: list[str], kinds: str, out: list[str], time: str, tie: list[str] | None, away_days: int):
        super().__init__(columns, kinds, out, time, tie)
        self.away_days = away_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "day string")

    def take(self, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        last, out = str(self.last.get()[0]) if self.last.exists() else "", []
        for row in rows:
            if row["day"] > last:
                away = (pd.Timestamp(row["day"]) - pd.Timestamp(last)).days if last else 0
                out.append(row | {"uu_ct": 1, "back_ct": int(away > self.away_days)})
                last = row["day"]
        if out:
            self.last.update((last,))
        return out


class NewFlag(InOrder):
    """Every row with ``is_new`` '0' where it says '1' on a day after the key's first day as new; state without end: that day.

    With ``backfill`` a row that says '0' makes all that come later, or at the same time, old.
    """

    def __init__(self, columns: list[str], kinds: str, out: list[str], time: str, backfill: bool):
        super().__init__(columns, kinds, out, time, ["is_new"])
        self.backfill = backfill

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getValueState("first", "day string")

    def take(self, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        before = first = str(self.first.get()[0]) if self.first.exists() else "~"  # "~": after all days, "": before them
        out = []
        for row in rows:
            new = row["is_new"] == "1"
            out.append(row | {"is_new": "0"} if new and row["day"] > first else row)
            first = min(first, row["day"]) if new else "" if self.backfill and row["is_new"] is not None else first
        if first != before:
            self.first.update((first,))
        return out


class Kept(InOrder):
    """Of a key's rows within ``wait_ms`` of its earliest the last one, or the first, by ``best``, once that time is over; later rows start anew. Its time is put off by as much."""

    def __init__(self, columns: list[str], kinds: str, out: list[str], time: str, best: list[str], wait_ms: int, last: bool):
        super().__init__(columns, kinds, out, time)
        self.best, self.wait_ms, self.last = best, wait_ms, last

    def wake(self, times: set[int]) -> None:
        super().wake({us + 1000 * self.wait_ms for us in times})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, wait = 1000 * int(timerValues.getCurrentWatermarkInMs()), 1000 * self.wait_ms
        held = sorted((dict(zip(self.columns, r, strict=True)) for r in self.held.get()), key=lambda r: r["at_us"])
        out = []
        while held and held[0]["at_us"] + wait <= passed:
            near = [r for r in held if r["at_us"] <= held[0]["at_us"] + wait]
            held = held[len(near) :]
            best = (max if self.last else min)(near, key=lambda r: _sort_key(r, self.best))
            out.append(best | {"at_us": best["at_us"] + wait})
        if out:
            self.held.clear()
            if held:
                self.held.put([tuple(r[c] for c in self.columns) for r in held])
            yield self.result(out)


class Bounces(StatefulProcessor):
    """Emits session starts (``starts``) whose next row starts a session, comes ``limit_ms`` later, or does not come in that time.

    Rows are held until the watermark has passed them and so until none can come between them: order of arrival is all the same.
    """

    def __init__(self, columns: list[str], kinds: str, limit_ms: int = 10_000, tie: list[str] | None = None):
        self.columns, self.kinds, self.limit_ms, self.by = columns, kinds, limit_ms, ["ms", *(tie or [])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", self.kinds)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = _rows(rows, self.columns, _whole(self.kinds))
        if found:
            self.held.appendList([tuple(r[c] for c in self.columns) for r in found])
            for ms in {int(r["ms"]) for r in found}:
                self.handle.registerTimer(ms + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = int(timerValues.getCurrentWatermarkInMs())
        rows = [dict(zip(self.columns, r, strict=True)) for r in self.held.get()]
        rows.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in self.by))
        out, keep = [], []
        for i, row in enumerate(rows):
            later = rows[i + 1] if i + 1 < len(rows) else None
            over = int(row["ms"]) + self.limit_ms
            if int(row["ms"]) > passed:
                keep.append(row)
            elif row["starts"]:
                known = later is not None and int(later["ms"]) <= passed
                if not known and over > passed:
                    keep.append(row)
                elif not known or later["starts"] or int(later["ms"]) >= over:
                    out.append(row)
        self.held.clear()
        if keep:
            self.held.put([tuple(r[c] for c in self.columns) for r in keep])
        if out:
            yield pd.DataFrame(out)[self.columns]

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    value = value.item() if hasattr(value, "item") else value
    return None if isinstance(value, float) and value != value else value


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {k}" for c, k in df.dtypes)


def _timed(df: DataFrame, time: str, late_ms: int = 0) -> DataFrame:
    """Rows with ``ms``, ``day`` and what the processors need (time and end of the day) in place of the timestamp that the watermark is on.

    ``late_ms`` is how much that timestamp has been put off by a step before; ``ms`` and ``day`` are those of the event.
    """
    at = F.timestamp_micros(F.unix_micros(time) - 1000 * late_ms)
    rows = df.withColumns({"ms": F.unix_millis(at), "day": F.date_format(at, "yyyy-MM-dd"), "at_us": F.unix_micros(time)})
    return rows.withColumn("day_end", F.unix_millis(F.date_add(at, 1).cast("timestamp")) + late_ms).drop(time)


def _run(rows: DataFrame, key: list[str], time: str, more: dict[str, str], processor: Callable[[list[str], str, list[str]], StatefulProcessor], hidden: list[str] | None = None) -> DataFrame:
    """The rows of ``_timed`` through a processor: their own columns and ``more`` ones, with the time and its watermark."""
    out = [c for c in rows.columns if c not in ("at_us", "day_end", *(hidden or []), *more)]
    kinds = f"{_kinds(rows.select(*out))}, {''.join(f'`{c}` {k}, ' for c, k in more.items())}`{time}` timestamp"
    made = processor(rows.columns, _kinds(rows), [*out, *more, time])
    return rows.groupBy(*key).transformWithStateInPandas(made, kinds, "Append", "EventTime", eventTimeColumnName=time)


def _marked(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    return df if watermark is None else df.withWatermark(time, watermark)


def first_per_day(df: DataFrame, key: list[str], time: str, tie: list[str] | None = None, watermark: str | None = "2 seconds") -> DataFrame:
    """A stream's first row per key and day, with ``ms`` and ``day`` of its time. Rows with a null key go.

    ``watermark`` None: the rows have one already. A key's state ends when the watermark passes the end of its day.
    """
    rows = _timed(_marked(df, time, watermark).dropna(subset=key), time)
    return _run(rows, key, time, {}, lambda columns, kinds, out: FirstPerDay(columns, kinds, out, time, tie))


def user_flags(df: DataFrame, user: str, time: str, unique: str, new: str, tie: list[str] | None = None, watermark: str | None = "2 seconds", late_ms: int = 0) -> DataFrame:
    """A stream's rows with ``unique`` 1 on a user's first row of a day, ``new`` 1 on the user's first row ever; without a user both are 0."""
    rows = _timed(_marked(df, time, watermark), time, late_ms)
    own = F.coalesce(F.col(user).cast("string"), F.concat(F.lit("\0"), F.pmod(F.xxhash64("at_us", *(tie or [])), F.lit(1024)).cast("string")))  # rows without a user stay apart
    more = {unique: "long", new: "long"}
    return _run(rows.withColumn("own_key", own), ["own_key"], time, more, lambda columns, kinds, out: UserFlags(columns, kinds, out, time, tie, user, unique, new), ["own_key"])


def daily_logins(df: DataFrame, user: str, time: str, away_days: int = 7, tie: list[str] | None = None, watermark: str | None = "2 seconds") -> DataFrame:
    """A stream's first login per user and day with ``uu_ct`` 1, and ``back_ct`` 1 if the login before was over ``away_days`` ago."""
    rows = _timed(_marked(df, time, watermark).dropna(subset=[user]), time)
    more = {"uu_ct": "long", "back_ct": "long"}
    return _run(rows, [user], time, more, lambda columns, kinds, out: Logins(columns, kinds, out, time, tie, away_days))


def fix_is_new(df: DataFrame, key: str, time: str, backfill: bool = False, watermark: str | None = "2 seconds") -> DataFrame:
    """A stream's rows with ``is_new`` repaired, and ``ms`` and ``day`` of their time. Rows with a null key go."""
    rows = _timed(_marked(df, time, watermark).dropna(subset=[key]), time)
    return _run(rows, [key], time, {}, lambda columns, kinds, out: NewFlag(columns, kinds, out, time, backfill))


def _kept(df: DataFrame, key: list[str], time: str, by: list[str] | None, watermark: str | None, wait_ms: int, last: bool) -> DataFrame:
    rows = _timed(_marked(df, time, watermark).dropna(subset=key), time).drop("day", "day_end")
    return _run(rows, key, time, {}, lambda columns, kinds, out: Kept(columns, kinds, out, time, by or ["ms"], wait_ms, last))


def latest(df: DataFrame, key: list[str], time: str, tie: list[str], watermark: str | None = "2 seconds", wait_ms: int = 5000, by: list[str] | None = None) -> DataFrame:
    """A stream's last row per key, by ``by`` or else time and ``tie``, released ``wait_ms`` after the key's earliest; ``ms`` is its time, and ``time`` that much later.

    Repeats are the rows within ``wait_ms`` of event time; a key's rows that come later still count as another one, as its state has ended.

    Steps that follow in the same query take ``late_ms``, and windows ``late``, for what the time is put off by.
    """
    return _kept(df, key, time, by or ["at_us", *tie], watermark, wait_ms, True)


def first(df: DataFrame, key: list[str], time: str, tie: list[str], watermark: str | None = "2 seconds", wait_ms: int = 5000, by: list[str] | None = None) -> DataFrame:
    """A stream's first row per key, as ``latest``."""
    return _kept(df, key, time, by or ["at_us", *tie], watermark, wait_ms, False)


def bounces(pages: DataFrame, time: str = "rt", watermark: str = "2 seconds", limit_ms: int = 10_000, tie: list[str] | None = None) -> DataFrame:
    """A stream's bounces; ``pages`` is flat, with ``mid`` and ``last_page_id``. A bounce is known ``limit_ms`` after its time: land the result before a windowed summary."""
    rows = pages.withWatermark(time, watermark).where("mid IS NOT NULL").withColumn("ms", F.unix_millis(time)).withColumn("starts", F.col("last_page_id").isNull())
    kept = [c for c in rows.columns if c != time]
    kinds = _kinds(rows.select(*kept))
    return rows.groupBy("mid").transformWithStateInPandas(Bounces(kept, kinds, limit_ms, tie), kinds, "Append", "EventTime")


def first_in_watermark(df: DataFrame, key: list[str], time: str, watermark: str = "2 seconds") -> DataFrame:
    """Keep the first row per key that arrives; a key is remembered until the watermark passes it."""
    return df.withWatermark(time, watermark).dropDuplicatesWithinWatermark(key)
