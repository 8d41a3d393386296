"""Keyed stream state that expires.

State lives in Spark's ``transformWithState`` and ends by a time to live: what a
key has not touched for that long is dropped by the state store. Time to live
runs by the clock of the job, the rules by the times of the rows; a row that
finds no state any more passes, as an unknown one does. Rows of a batch are
handled with arrays, not one by one.
"""
from __future__ import annotations

import json
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
HOUR_MS = 3_600_000
IDLE_MS = 30 * 24 * HOUR_MS


class Keyed(StatefulProcessor):
    """A processor that knows the names of what it puts out."""

    names: list[str]

    def close(self) -> None:
        pass


def with_state(stream: DataFrame, keys: list[str], processor: Keyed, out: str) -> DataFrame:
    """The processor per key, appending; such state needs a store that can expire it.

    Rows of many keys travel in one Arrow batch, which is what counts where keys are many and small.
    """
    processor.names = [c.split()[0] for c in out.split(", ")]
    conf = stream.sparkSession.conf
    if "RocksDB" not in (conf.get(PROVIDER, None) or ""):
        conf.set(PROVIDER, ROCKSDB)
    return stream.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="processingTime")


def expires(df: DataFrame) -> bool:
    """The stream has state with a time to live. Such a query plans batches without rows for ever, to look for what has expired."""
    return "TransformWithState" in df._jdf.queryExecution().analyzed().toString()


def in_order(rows: Iterator[Row]) -> tuple[list[tuple], np.ndarray]:
    """Rows (key, time, id) by time and id, and their times."""
    rows = sorted((tuple(r) for r in rows), key=lambda r: r[1:])
    return rows, np.array([r[1] for r in rows], np.int64)


# -- decisions over the sorted times of one key --------------------------------
def passed_on(times: np.ndarray, last: int | None, span: int) -> tuple[np.ndarray, int | None]:
    """Which rows are no repeats, and the time of the last such row: jumps from one to the next."""
    keep, at = np.zeros(len(times), bool), 0
    while at < len(times):
        if last is not None and last <= times[at] <= last + span:
            at = int(np.searchsorted(times, last + span, side="right"))
            continue
        keep[at], last = True, int(times[at])
        at += 1
    return keep, last


def learnt(times: np.ndarray, recent: list[int], occurrences: int, span: int) -> tuple[int, int, list[int]]:
    """``(late, from, recent)``: leading rows behind the last known time, the row that admits (or the number of rows), and the times to remember."""
    late = int(np.searchsorted(times, recent[-1])) if recent else 0
    known = np.concatenate([np.array(recent, np.int64), times[late:]])
    full = np.flatnonzero(known[occurrences - 1:] - known[:len(known) - occurrences + 1] <= span) + occurrences - 1 if len(known) >= occurrences else np.empty(0, np.int64)
    full = full[full >= len(recent)]
    if len(full):
        return late, late + int(full[0]) - len(recent), []
    return late, len(times), [int(t) for t in known if known[-1] - t <= span][-occurrences + 1:] if len(known) and occurrences > 1 else []


def rates(times: np.ndarray, held_slots: np.ndarray, held_counts: np.ndarray, slot_us: int, slots: int) -> np.ndarray:
    """Rows so far in the last ``slots`` slots, for every row in time order."""
    own = times // slot_us
    before = np.append(0, np.cumsum(held_counts))
    inside = before[np.searchsorted(held_slots, own, side="right")] - before[np.searchsorted(held_slots, own - slots, side="right")]
    # Slots that an earlier row of the batch left behind do not come back: times ascend.
    return np.maximum(inside, 0) + np.arange(1, len(own) + 1) - np.searchsorted(own, own - slots, side="right")


def holds(times: np.ndarray, hot: np.ndarray, last: int | None, hold: int) -> tuple[np.ndarray, int | None]:
    """Whether the hold of an earlier anomaly is over at each row, and the time of the last anomaly."""
    number = np.maximum.accumulate(np.where(hot, np.arange(len(times)), -1))
    earlier = np.append(-1, number[:-1])
    before = np.where(earlier >= 0, times[np.maximum(earlier, 0)], -1 if last is None else last)
    free = (earlier < 0) & (last is None) | (times > before + hold)
    return free, int(times[number[-1]]) if len(times) and number[-1] >= 0 else last


def assembled(rows: pd.DataFrame, now: int, age: int, required: tuple[str, str]) -> tuple[pd.DataFrame, dict[str, list]]:
    """Records that are whole or too old at the watermark ``now``, and the lines that stay, as lists.

    Lines: id, ms, due, kind, idx, value; ``due`` is -1 in new lines. An id ends
    ``age`` after its first line, but not in a batch that brings lines of it.
    """
    code, ids = pd.factorize(rows["id"])
    n, kind = len(ids), rows["kind"]
    of = lambda mask: np.bincount(code[np.asarray(mask, bool)], minlength=n)
    fresh = of(rows["due"] < 0) > 0
    first, due = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    np.minimum.at(first, code, rows["ms"].to_numpy(np.int64))
    np.maximum.at(due, code, rows["due"].to_numpy(np.int64))
    due = np.where(fresh, np.maximum(first + age, now + 1), due)
    whole = (of(kind == required[0]) > 0) & (of(kind == required[1]) > 0)
    sent = whole | (~fresh & (due < now))
    lines = pa.table({"code": code, "idx": pa.array(rows["idx"], pa.int32(), from_pandas=True), "value": pa.array(rows["value"], pa.string(), from_pandas=True)})
    order = pc.sort_indices(lines, sort_keys=[("code", "ascending"), ("idx", "ascending"), ("value", "ascending")]).to_numpy()
    order = order[sent[code[order]]]
    values, which = lines["value"].combine_chunks(), np.flatnonzero(sent)

    def joined(name: str) -> pa.Array:
        own = order[np.asarray(kind == name, bool)[order]]
        ends = np.cumsum(np.bincount(code[own], minlength=n))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values.take(pa.array(own))), " ").take(pa.array(which))

    out = pd.DataFrame({"id": ids[which], "a": joined(required[0]).to_pandas(), "b": joined(required[1]).to_pandas(), "n_lines": np.bincount(code, minlength=n)[which], "status": np.where(whole[which], "complete", "expired")})
    stay = ~sent[code]
    kept = pa.array(stay)
    return out, {"id": rows["id"][stay].tolist(), "ms": rows["ms"][stay].tolist(), "due": due[code][stay].tolist(), "kind": rows["kind"][stay].where(rows["kind"][stay].notna(), None).tolist(),
                 "idx": lines["idx"].filter(kept).to_pylist(), "value": lines["value"].filter(kept).to_pylist()}


def snapshot_changes(own: dict[str, str], part: list[tuple[str, str]], baseline: bool) -> Iterator[tuple[str, str | None, str, list[str], dict[str, str]]]:
    """``(entity, fields, action, changed, old)`` of a snapshot against ``own``, which becomes the snapshot; deleted ones have no fields."""
    now: dict[str, str] = {}
    for entity, fields in part:
        other = now.setdefault(entity, fields)
        if other != fields:
            now[entity] = max(other, fields, key=lambda f: [(v is not None, v) for v in json.loads(f).values()])
    for entity, fields in now.items():
        known = own.get(entity)
        if known != fields:
            own[entity] = fields
            if known is None:
                yield entity, fields, "observed" if baseline else "created", [], {}
            else:
                old, new = json.loads(known), json.loads(fields)
                changed = {n: old[n] for n in old if old[n] != new[n]}
                yield entity, fields, "observed" if baseline else "modified", list(changed), changed
    for entity in [e for e in own if e not in now]:
        yield entity, None, "deleted", [], json.loads(own.pop(entity))


# -- processors ---------------------------------------------------------------
class Dedupe(Keyed):
    """State: the time of the last row that was passed on."""

    def __init__(self, span: int, ttl_ms: int):
        self.span, self.ttl_ms = span, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows, times = in_order(rows)
        found = self.last.get()
        keep, last = passed_on(times, found[0] if found else None, self.span)
        if keep.any():
            self.last.update((last,))
        made = Row(*self.names)
        return (made(*rows[i]) for i in np.flatnonzero(keep))


class Learning(Keyed):
    """State: the recent times of a candidate, or the fact of admission, each with its own time to live."""

    def __init__(self, occurrences: int, span: int, candidate_ms: int, admitted_ms: int):
        self.occurrences, self.span, self.ttl = occurrences, span, (candidate_ms, admitted_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "recent array<bigint>", self.ttl[0])
        self.admitted = handle.getValueState("admitted", "since bigint", self.ttl[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows, times = in_order(rows)
        at, late = 0, 0
        since = self.admitted.get()
        if not since:
            found = self.recent.get()
            late, at, recent = learnt(times, list(found[0]) if found else [], self.occurrences, self.span)
            if at < len(times):
                since = (int(times[at]),)
                self.recent.clear()
            elif late < len(times):
                self.recent.update((recent,))
        if since:
            self.admitted.update((since[0],))  # every row keeps it alive
        known = at if since else len(rows)
        made = Row(*self.names)
        return (made(*r, "suppress", "baseline_match") if i >= known else made(*r, "emit", "clock_regression" if i < late else "learning") for i, r in enumerate(rows))


class Rate(Keyed):
    """State: the filled slots and the time of the last anomaly."""

    def __init__(self, limit: int, slot_us: int, slots: int, hold: int, ttl_ms: int):
        self.limit, self.slot_us, self.slots, self.hold, self.ttl_ms = limit, slot_us, slots, hold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filled = handle.getValueState("filled", "slots array<bigint>, counts array<bigint>, last bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows, times = in_order(rows)
        found = self.filled.get()
        slots, counts, last = (np.array(found[0], np.int64), np.array(found[1], np.int64), found[2]) if found else (np.empty(0, np.int64), np.empty(0, np.int64), None)
        rate = rates(times, slots, counts, self.slot_us, self.slots)
        hot = rate > self.limit
        free, last = holds(times, hot, last, self.hold)
        own, n = np.unique(times // self.slot_us, return_counts=True)
        slots, back = np.unique(np.concatenate([slots, own]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        stay = slots > own[-1] - self.slots
        self.filled.update((slots[stay].tolist(), counts[stay].tolist(), last))
        made = Row(*self.names)
        return (made(*r, *marks) for r, marks in zip(rows, zip(rate.tolist(), hot.tolist(), (hot & free).tolist(), (hot | ~free).tolist())))


class Snapshots(Keyed):
    """State: the entities of one host and collection, keyed by entity and changed in place.

    Rows hold the group, the snapshot's number, the entity and its fields, the
    last two as JSON; NULL entities only tell that there was a snapshot.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entities = handle.getMapState("entities", "entity string", "seen bigint, fields string", self.ttl_ms)
        self.seen = handle.getValueState("seen", "last bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parts: dict[int, list[tuple[str, str]]] = {}
        for *_, snap, entity, fields in map(tuple, rows):
            parts.setdefault(snap, []).extend([(entity, fields)] if entity is not None else [])
        found, out = self.seen.get(), []
        last = found[0] if found else None
        own = {entity[0]: value[1] for entity, value in self.entities.iterator()} if last is not None else {}
        for snap, part in sorted(parts.items()):
            if last is not None and snap <= last:
                continue  # an older snapshot, or one that came before, tells nothing new
            for entity, fields, *change in snapshot_changes(own, part, last is None):
                out.append((snap, entity, *change))
                if fields is None:
                    self.entities.removeKey((entity,))
                else:
                    self.entities.updateValue((entity,), (snap, fields))
            last = snap
        if last is not None:
            self.seen.update((last,))
        made = Row(*self.names)
        return (made(*key, *o) for o in out)


class SnapshotBuckets(Keyed):
    """State: the groups of one bucket with their entities, side by side in one row.

    ``touched`` is when a group last sent rows; groups idle for the time to live
    are left out when the bucket is read, a bucket of idle groups expires whole.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "name array<string>, last array<bigint>, touched array<bigint>, size array<int>, entity array<string>, fields array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        parts: dict[str, tuple[tuple, dict[int, list[tuple[str, str]]]]] = {}
        for _, *group, name, snap, entity, fields in map(tuple, rows):
            part = parts.setdefault(name, (tuple(group), {}))[1].setdefault(snap, [])
            if entity is not None:
                part.append((entity, fields))
        groups, at = {}, 0
        names, lasts, touched, sizes, entities, values = self.held.get() or ([], [], [], [], [], [])
        for name, last, seen, size in zip(names, lasts, touched, sizes):
            if not self.ttl_ms or seen + self.ttl_ms > now:
                groups[name] = (last, seen, at, at + size)
            at += size
        kept, out = ([], [], [], [], [], []), []

        def keep(name, last, seen, own, fields):
            for column, more in zip(kept, ([name], [last], [seen], [len(own)], own, fields)):
                column.extend(more)

        for name, (last, seen, a, b) in groups.items():
            if name not in parts:
                keep(name, last, seen, entities[a:b], values[a:b])
        for name, (group, snaps) in parts.items():
            last, _, a, b = groups.get(name, (None, now, 0, 0))
            own = dict(zip(entities[a:b], values[a:b]))
            for snap, part in sorted(snaps.items()):
                if last is None or snap > last:
                    out.extend((*group, snap, entity, *change) for entity, _, *change in snapshot_changes(own, part, last is None))
                    last = snap
            keep(name, last, now, list(own), list(own.values()))
        self.held.update(kept)
        made = Row(*self.names)
        return (made(*o) for o in out)
