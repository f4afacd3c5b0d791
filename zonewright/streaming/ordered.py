"""Keyed state over streams whose rows come late, twice or out of order.

Rows wait in state until the watermark has passed them and are then handled in event time, so what a machine decides doesn't depend on how the stream was cut into batches or in which
order rows came: it equals the same rule over the ordered log. Rows behind the watermark are dropped by the engine and counted in the query's progress.
Timers are in milliseconds; a row counts as passed when its millisecond is below the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Holds rows (at: milliseconds, n: tie breaker, other columns as `values`) until the watermark passes, then calls passed() for each in order, and due() with how far
    time has come. Subclasses keep their own state and name the columns they need. A row given twice (same at and n) is one.

    Each use of the engine's state is a round trip to the JVM, so rows wait in a list that is read and written as a whole, a machine's state is loaded once before its rows and saved once behind
    them, and of the rows that wait only the first has a timer."""

    values: tuple[str, ...] = ()
    kinds: str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, n long, {self.kinds}")
        self.wakes: set[int] = set()
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Makes the machine's own state."""

    def load(self) -> None:
        """Reads the key's state."""

    def save(self) -> None:
        """Writes back what has changed of it."""

    def passed(self, key: tuple, at: int, n: int, row: tuple) -> Iterator[tuple]:
        """Handles one row; yields output rows."""
        yield from ()

    def due(self, key: tuple, now: int) -> Iterator[tuple]:
        """Time has come to now, all rows up to then are handled; yields output rows."""
        yield from ()

    def wake(self, at: int) -> None:
        """Calls due() once the watermark has passed at."""
        self.wakes.add(at)

    # Both handlers do their work before they return: the engine sets the key whose state they see for the length of the call only.

    def handleInputRows(self, key, rows, timerValues):
        longs = [kind.split()[1] == "long" for kind in self.kinds.split(",")]  # a column with nulls comes as doubles
        new = []
        for frame in rows:
            for at, n, *row in frame[["at", "n", *self.values]].itertuples(index=False, name=None):
                new.append((int(at), int(n), *(None if pd.isna(x) else int(x) if whole else x for x, whole in zip(row, longs))))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = int(timerValues.getCurrentWatermarkInMs()) - 1  # all that has passed, not this timer's alone: what the next ones would do is done
        rows = {(int(r[0]), int(r[1])): tuple(r[2:]) for r in self.waiting.get()}
        ready = sorted(k for k in rows if k[0] <= now)
        out = []
        self.wakes.clear()
        self.load()
        for at, n in ready:
            out += self.passed(key, at, n, rows.pop((at, n)))
        out += self.due(key, now)
        self.save()
        if ready and rows:
            self.waiting.put([(*k, *row) for k, row in rows.items()])
        elif ready:
            self.waiting.clear()
        if rows:
            self.wakes.add(min(at for at, _ in rows))
        for at in self.wakes:
            if at > now:  # due() has just seen to the others
                self.handle.registerTimer(at)
        return iter([self._frame(out)] if out else ())

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate(self.columns.items())})

    #: Output columns and their pandas types, the key's first.
    columns: dict[str, str] = {}


def run_machine(stream: DataFrame, machine: Ordered, by: list[str], time: str, late: str, schema: str) -> DataFrame:
    """A machine over a stream with columns at and n; rows later than `late` behind the newest are dropped."""
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        spark.conf.set(*PROVIDER)
    return stream.withWatermark(time, late).groupBy(*by).transformWithStateInPandas(machine, schema, "Append", "EventTime")
