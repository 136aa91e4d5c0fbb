"""The session memory as a stream: turns arrive, and each gives the memory after it.

The state of a session is a map with an entry for each concept, and the last turn that it has heard; both lie in the state store (RocksDB), so
that a turn reads a session's entries once and writes those alone that it has changed. Turns must arrive in order over micro-batches;
within one they are sorted. A turn that comes late, at or before the last one heard, would change memories that were told already: it
is refused, and its negatives go out marked `late`, for whoever keeps them. A turn that stands twice in a batch is late the second
time. The number of a session's entries is bounded by the cap on its concepts.

A stream may begin from a batch memory (`initial`). With `forget_after_ms`, a session that is silent for so long is forgotten, and begins
anew if it speaks again; without it the state is kept until the checkpoint is dropped. Spark goes on making batches for timers: a
trigger that ends when all is read then needs spark.sql.streaming.noDataMicroBatches.enabled = false.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import MemoryConfig
from ..operators.memory import Entry, fold_session

OUT = "session_id long, turn int, concept string, surface string, confidence double, created int, updated int, late boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]
KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}


def struct(fields: str) -> T.StructType:
    """As the DDL that it is given; workers have no session to parse one."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split() for f in fields.split(", "))])


ENTRY = struct("place long, name string, surface string, polarity string, confidence double, created int, updated int, overrides int")
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class SessionMemory(StatefulProcessor):
    def __init__(self, config: MemoryConfig, forget_after_ms: int | None):
        self.config, self.forget_after_ms = config, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", struct("concept string"), ENTRY)
        self.heard = handle.getValueState("heard", struct("turn int, places long"))

    def remembered(self) -> tuple[dict[str, Entry], dict[str, int]]:
        """Entries in the order that they came in, and their places."""
        rows = sorted(((v[0], k[0], v) for k, v in self.entries.iterator()), key=lambda r: r[0])
        return {k: Entry(*v[1:7], None, v[7]) for _, k, v in rows}, {k: place for place, k, _ in rows}

    def write(self, was: dict[str, tuple], kept: dict[str, Entry], places: dict[str, int], turn: int, next_place: int) -> None:
        for k in was.keys() - kept.keys():
            self.entries.removeKey((k,))
        for k, e in kept.items():
            if k not in was or k not in places:
                places[k], next_place = next_place, next_place + 1
            now = (places[k], *values(e))
            if was.get(k) != now:
                self.entries.updateValue((k,), now)
        self.heard.update((turn, next_place))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, next_place = self.heard.get() if self.heard.exists() else (None, 0)
        kept, places = self.remembered()
        was = {k: (places[k], *values(e)) for k, e in kept.items()}
        turns, events, late = [], [], []
        for r in pd.concat(list(rows)).sort_values("turn", kind="stable").itertuples():
            negatives = list(r.negatives)
            if last is not None and r.turn <= last:
                late += [(key[0], int(r.turn), n["concept"], n["attribute"], float(n["confidence"]), None, None, True) for n in negatives] or [(key[0], int(r.turn), None, None, None, None, None, True)]
                continue
            last = int(r.turn)
            turns.append(last)
            events += [(last, int(n["idx"]), n["concept"], n["attribute"], float(n["confidence"]), None, "negative") for n in negatives]
        out = [(key[0], t, c, s, f, made, upd, False) for t, c, _, s, _, f, made, upd, *_ in fold_session(turns, events, self.config, kept)]
        if turns:
            self.write(was, kept, places, last, next_place)
        if self.forget_after_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_after_ms)
        yield frame(out + late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        self.heard.clear()
        yield frame([])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        rows = initialState.sort_values("position")
        last = int(rows["turn"].max())
        rows = rows[rows["concept"].notna()]
        for place, r in enumerate(rows.itertuples()):
            self.entries.updateValue((r.concept,), (place, r.name, r.surface, r.polarity, float(r.confidence), int(r.created), int(r.updated), int(r.overrides)))
        self.heard.update((last, len(rows)))

    def close(self) -> None:
        pass


def values(e: Entry) -> tuple:
    return (e.name, e.surface, e.polarity, e.confidence, e.created, e.updated, e.overrides)


def frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"session_id": "int64", "turn": "int32", "created": "Int32", "updated": "Int32", "late": "bool"}
    return pd.DataFrame(rows, columns=NAMES).astype(kinds)


def as_initial(states: DataFrame, folded: DataFrame) -> DataFrame:
    """What a stream begins from: each session's memory (of memory.folded_memory) after its last state, with that state's turn."""
    last = states.groupBy("session_id").agg(F.max("turn").alias("turn"))
    names = ["concept", "name", "surface", "polarity", "confidence", "created", "updated", "overrides", "position"]
    return last.join(folded.select("session_id", "turn", F.struct(*names).alias("x")).hint("merge"), ["session_id", "turn"], "left").select("session_id", "turn", *(F.col(f"x.{c}").alias("name_" if c == "name" else c) for c in names)).withColumnRenamed("name_", "name")


def live_memory(turns: DataFrame, config: MemoryConfig, forget_after_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """turns: session_id, turn, negatives array<struct<idx, concept, attribute, confidence>> (empty for turns without any).

    Rows with late = false are memories, a row for each concept after each turn; those with late = true are what was refused. The
    session's state store is set to RocksDB, which such states need.
    """
    turns.sparkSession.conf.set(*STORE)
    processor = SessionMemory(config, forget_after_ms)
    begin = None if initial is None else initial.groupBy("session_id")
    return turns.groupBy("session_id").transformWithStateInPandas(processor, OUT, "Append", "None" if forget_after_ms is None else "ProcessingTime", begin)
