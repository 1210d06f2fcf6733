"""Keyed state over streams: positions scored once, live games, and quotes that expire.

Each operator holds a bounded state a key, by ``transformWithState``; set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider (``use_rocksdb``)
before a query starts. What comes out does not depend on the order in which rows
arrive within the watermark, nor on rows that come again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from fungo.operators import pricing as R

LOOKBACK = 4


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed map states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Once(StatefulProcessor):
    """Positions of a game that have not come out yet. State: those that have, for the latest plate appearances only."""

    def __init__(self, lookback: int, idle_ms: int):
        self.lookback, self.idle_ms = lookback, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at_bat_index int, last_ms long")
        self.done = handle.getMapState("done", "at_bat_index int", "positions array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        newest, last = self.newest.get() if self.newest.exists() else (-1, -1)
        before = last
        seen: dict[int, dict[int, Row]] = {}
        out_of_reach = newest - self.lookback
        for r in rows:
            newest, last = max(newest, r.at_bat_index), max(last, r.ms)
            if r.at_bat_index > out_of_reach:
                calls = seen.setdefault(r.at_bat_index, {})
                calls.setdefault(0, r)
                if r.pitch_number and not r.closes:
                    calls.setdefault(r.pitch_number, r)
        for at_bat in sorted(seen):
            held = list(self.done.getValue((at_bat,))[0]) if self.done.containsKey((at_bat,)) else []
            new = sorted(set(seen[at_bat]) - set(held))
            if new:
                self.done.updateValue((at_bat,), (held + new,))
            for k in new:
                r = seen[at_bat][k]
                yield Row(game_pk=key[0], at_bat_index=at_bat, pitch_number=k, pitcher_id=r.pitcher_id, batter_id=r.batter_id, balls=r.balls if k else 0, strikes=r.strikes if k else 0, first_of_pa=not held and k == new[0])
        for (at_bat,) in [k for k in self.done.keys() if k[0] <= newest - self.lookback]:
            self.done.removeKey((at_bat,))
        self.newest.update((newest, last))
        if before >= 0:
            self.handle.deleteTimer(before + self.idle_ms)
        self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        self.done.clear()
        return iter(())

    def close(self) -> None:
        pass


POSITIONS = "game_pk long, at_bat_index int, pitch_number int, pitcher_id int, batter_id int, balls int, strikes int, first_of_pa boolean"


def open_positions(events: DataFrame, ts: str = "ts", late: str = "10 minutes", lookback: int = LOOKBACK, idle_hours: int = 12) -> DataFrame:
    """Each position of each plate appearance once, with the count there.

    ``events`` are pitches (game_pk, at_bat_index, pitch_number, pitcher_id, batter_id,
    balls and strikes after it, closes, ts); a row without a pitch number only
    announces the plate appearance. Position k is the call after k pitches:
    position 0 of every plate appearance, and k for every pitch k that does not
    close it. ``first_of_pa`` marks the first that comes out of a plate appearance,
    for calls that are made once in it. Rows of plate appearances ``lookback`` or more
    behind the newest that earlier batches brought are not scored any more; their
    positions are forgotten, and a game idle for ``idle_hours`` is forgotten as a whole.
    """
    slim = events.withWatermark(ts, late).where("game_pk is not null and at_bat_index is not null").select(
        F.col("game_pk").cast("long"), ts, *(F.col(c).cast("int") for c in ("at_bat_index", "pitch_number", "pitcher_id", "batter_id", "balls", "strikes")), F.coalesce("closes", F.lit(False)).alias("closes"), F.unix_millis(ts).alias("ms")
    )
    return slim.groupBy("game_pk").transformWithState(_Once(lookback, idle_hours * 3_600_000), POSITIONS, "append", "eventTime")


def score_once(events: DataFrame, pitcher_stats: DataFrame, batter_stats: DataFrame, params: Mapping | None = None, digits: int = 6, **how: Any) -> DataFrame:
    """Every uncovered position once, with the chances of the next pitch from the rolling figures at hand (a stream-static join)."""
    positions = open_positions(events, **how)
    ctx = R.scoring_context(positions.withColumn("pitch_number", F.col("pitch_number") + 1), pitcher_stats, batter_stats)
    probs = R.pitch_result_probs(params)
    name, most = R.top_class(probs)
    return ctx.select("game_pk", "at_bat_index", F.col("pitch_count_pa").alias("pitch_number"), "first_of_pa", F.lit("pitch_result").alias("market"), *(F.round(p, digits).alias(f"p_{k}") for k, p in probs.items()), name.alias("recommendation"), F.round(most, digits).alias("confidence"))


class _Game(StatefulProcessor):
    """The latest play of a game; it comes out when instant, plate appearance, count of pitches or batter change."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, at_bat_index int, pitch_count_pa int, batter_id int, pitcher_id int, balls int, strikes int, home_score int, away_score int")

    def _row(self, key: Any, held: tuple, status: str) -> Row:
        ms, at_bat, count, batter, pitcher, balls, strikes, home, away = held
        return Row(game_pk=key[0], last_ms=ms, status=status, at_bat_index=at_bat, pitch_count_pa=count, batter_id=batter, pitcher_id=pitcher, balls=balls, strikes=strikes, home_score=home, away_score=away)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = tuple(self.last.get()) if self.last.exists() else None
        before, best = held, held
        for r in rows:
            now = (r.ms, r.at_bat_index, r.pitch_number or 0, r.batter_id, r.pitcher_id, r.balls, r.strikes, r.home_score, r.away_score)
            if best is None or now[:3] > best[:3]:
                best = now
        if best is None or best == before:
            return
        self.last.update(best)
        if before is not None:
            self.handle.deleteTimer(before[0] + self.idle_ms)
        self.handle.registerTimer(best[0] + self.idle_ms)
        if before is None or best[:4] != before[:4]:
            yield self._row(key, best, "In Progress")

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            held = tuple(self.last.get())
            self.last.clear()
            yield self._row(key, held, "Final")

    def close(self) -> None:
        pass


GAMES = "game_pk long, last_ms long, status string, at_bat_index int, pitch_count_pa int, batter_id int, pitcher_id int, balls int, strikes int, home_score int, away_score int"


def live_games(events: DataFrame, ts: str = "ts", late: str = "10 minutes", idle_minutes: int = 20) -> DataFrame:
    """The state of each game whenever its latest play changes; a game idle in event time comes out as final and is forgotten."""
    slim = events.withWatermark(ts, late).where("game_pk is not null").select(
        F.col("game_pk").cast("long"), ts, *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("at_bat_index", "pitch_number")), *(F.col(c).cast("int") for c in ("batter_id", "pitcher_id", "balls", "strikes", "home_score", "away_score")), F.unix_millis(ts).alias("ms")
    )
    found = slim.groupBy("game_pk").transformWithState(_Game(idle_minutes * 60_000), GAMES, "update", "eventTime")
    return found.select("game_pk", F.timestamp_millis("last_ms").alias("last_ts"), *[c.split()[0] for c in GAMES.split(", ")[2:]])


class _Quote(StatefulProcessor):
    """The newest quote of a key until its time is over."""

    def __init__(self, keys: Sequence[str], fields: Sequence[str], schema: str, live_ms: int):
        self.keys, self.fields, self.schema, self.live_ms = keys, fields, schema, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = tuple(self.last.get()) if self.last.exists() else None
        best = held
        for r in rows:
            if best is None or (r["__us"], r["id"]) > best[:2]:
                best = tuple(r[f] for f in self.fields)
        if best is None or best == held:
            return
        over = best[0] // 1000 + self.live_ms + 1  # a quote of just the full age still counts
        if over <= timerValues.getCurrentWatermarkInMs():
            return
        if held is not None:
            self.handle.deleteTimer(held[0] // 1000 + self.live_ms + 1)
        self.last.update(best)
        self.handle.registerTimer(over)
        yield self._row(key, best, False)

    def _row(self, key: Any, held: tuple, expired: bool) -> Row:
        return Row(*self.keys, *self.fields, "expired")(*key, *held, expired)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            held = tuple(self.last.get())
            self.last.clear()
            yield self._row(key, held, True)

    def close(self) -> None:
        pass


def expiring_quotes(odds: DataFrame, keys: Sequence[str], minutes: int = 30, ts: str = "fetched_at", late: str = "10 minutes") -> DataFrame:
    """The newest quote of each key as it changes, and once more, with ``expired`` set, when it is older than ``minutes`` in event time.

    Ties of the instant go to the greater id. Keys without a part are not quotes
    of anything and are left out. At a watermark the keys not expired are those of
    the latest quotes no older than ``minutes`` before it.
    """
    rest = [c for c in odds.columns if c not in (*keys, ts, "id")]
    kept = odds.withWatermark(ts, late).where(" and ".join(f"{k} is not null" for k in [*keys, "id", ts]))
    slim = kept.select(*keys, ts, F.unix_micros(ts).alias("__us"), F.col("id").cast("long").alias("id"), *rest)
    plain = slim.select(*keys, "__us", "id", *rest).schema
    fields = ["__us", "id", *rest]
    state = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain if f.name in fields)
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    found = slim.groupBy(*keys).transformWithState(_Quote(keys, fields, state, minutes * 60_000), f"{whole}, expired boolean", "update", "eventTime")
    return found.select(*keys, "id", F.timestamp_micros("__us").alias(ts), *rest, "expired")
