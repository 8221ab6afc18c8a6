"""Lifecycle fold: ordered stage events to one state per key, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "reached int, final_usable boolean, failure_stage string, failure_code string"


def fan_out(events: DataFrame, members: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """Events with every one that has no key of its own repeated for each member of its scope, such as (project, variant)."""
    own = events.filter(F.col(key).isNotNull())
    wide = events.filter(F.col(key).isNull()).drop(key).join(members.select(key, *scope).distinct(), scope)
    return own.unionByName(wide.select(*own.columns))


def _step(state: Column, e: Column) -> Column:
    """One event on (reached, failed, code): it counts only when all earlier stages are reached."""
    at = e["_p"]
    counts = at <= state["reached"] + 1
    success, failure = counts & e["ok"], counts & ~e["ok"]
    own = state["failed"] == at
    reached = F.when(success, F.greatest(state["reached"], at)).when(failure, F.least(state["reached"], at - 1)).otherwise(state["reached"])
    code = F.when(failure, F.coalesce(e["code"], F.when(own, state["code"]))).when(success & own, F.lit(None).cast("string")).otherwise(state["code"])
    failed = F.when(failure, at).when(success & own, F.lit(0)).otherwise(state["failed"])
    kept = F.when(failure, own & e["code"].isNull() & state["kept"]).when(success & own, F.lit(False)).otherwise(state["kept"])
    return _state(reached, code, failed, kept)


def _state(reached: Column, code: Column, failed: Column, kept: Column) -> Column:
    """kept: the code is still the one from before the events, which is not known yet."""
    return F.struct(reached.alias("reached"), code.alias("code"), failed.alias("failed"), kept.alias("kept"))


def _start(reached: int, failed: int) -> Column:
    return _state(F.lit(reached), F.lit(None).cast("string"), F.lit(failed), F.lit(failed > 0))


def _resume(state: Column, part: Column) -> Column:
    """The state after a slice: its result for the state before it, with that state's code where it is kept."""
    end = F.get(part["ends"], state["reached"] * 2 + (state["failed"] > 0).cast("int"))
    return _state(end["reached"], F.coalesce(end["code"], F.when(end["kept"], state["code"])), end["failed"], F.lit(False))


def fold_events(events: DataFrame, key: str, order: list[str], stages: list[str], slices: Column | None = None) -> DataFrame:
    """(key, reached, final_usable, failure_stage, failure_code).

    Events have columns stage, ok and code. A stage's flag is set by a successful event and cleared by a failed one,
    but an event counts only when all earlier stages' flags are set; a stored failure code survives a later failure of
    the same stage that has none. The final stage is the first without its flag. The fold is a built-in aggregate over
    a key's sorted events; events of unknown stages are left out.

    ``slices``, a column that never falls along ``order`` (such as the day of its first column), bounds what one task
    gathers for a hot key: each (key, slice) is folded from every possible state, of which there are 2 * stages + 1, as a
    failed stage is always the first one not reached; a key's slices are then taken in order. The result is the same.
    """
    position = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")).cast("int")
    known = events.withColumn("_p", position).filter("_p > 0")
    listed = F.sort_array(F.collect_list(F.struct(*order, "_p", "ok", "code"))).alias("_events")
    if slices is None:
        folded = known.groupBy(key).agg(listed).withColumn("_s", F.aggregate("_events", _start(0, 0), _step))
        return _read(folded, key, stages)
    starts = F.array(*[_start(r, f * (r + 1)) for r in range(len(stages) + 1) for f in (0, 1) if r + f <= len(stages)])
    parts = known.withColumn("_slice", slices).groupBy(key, "_slice").agg(listed).withColumn("ends", F.transform(starts, lambda s: F.aggregate("_events", s, _step)))
    joined = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_slice", "ends"))).alias("_parts"))
    return _read(joined.withColumn("_s", F.aggregate("_parts", _start(0, 0), _resume)), key, stages)


def _read(folded: DataFrame, key: str, stages: list[str]) -> DataFrame:
    names = F.array(*[F.lit(s) for s in stages])
    return folded.select(key, F.col("_s.reached").alias("reached"), (F.col("_s.reached") == len(stages)).alias("final_usable"), F.get(names, F.col("_s.reached")).alias("failure_stage"), F.col("_s.code").alias("failure_code"))


class _Fold(StatefulProcessor):
    """Keeps a key's (reached, failed, code, last order); an event that is not later than the last one is dropped and counted."""

    def __init__(self, key: str, order: str, stages: list[str]):
        self.key, self.order, self.stages = key, order, {s: i + 1 for i, s in enumerate(stages)}
        self.names = stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "reached int, failed int, code string, last long, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reached, failed, code, last, late = self.state.get() if self.state.exists() else (0, 0, None, None, 0)
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for at, stage, ok, said in zip(events[self.order], events["stage"], events["ok"], events["code"], strict=True):
            if last is not None and at <= last:
                late += 1
                continue
            last, place = int(at), self.stages.get(stage)
            if place is None or place > reached + 1:
                continue
            own = failed == place
            if ok:
                reached, code, failed = max(reached, place), None if own else code, 0 if own else failed
            else:
                said = None if pd.isna(said) else said
                reached, code, failed = min(reached, place - 1), said if said is not None else (code if own else None), place
        self.state.update((reached, failed, code, last, late))
        stage = self.names[reached] if reached < len(self.names) else None
        yield pd.DataFrame({self.key: [key[0]], "reached": [reached], "final_usable": [reached == len(self.names)], "failure_stage": [stage], "failure_code": [code], "late": [late]})

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, key: str, order: str, stages: list[str]) -> DataFrame:
    """The same fold over a stream, with the state of each key kept between batches; one row for each key that a batch touches.

    ``order`` is a whole number that grows with a key's events; one that is not above the key's last is late: it is
    dropped and counted in ``late``. Run it in update mode over the RocksDB state store.
    """
    kind = dict(events.dtypes)[key]
    return events.groupBy(key).transformWithStateInPandas(_Fold(key, order, stages), f"`{key}` {kind}, {RESULT}, late long", "Update", "None")
