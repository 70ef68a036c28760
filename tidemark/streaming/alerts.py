"""Sustained alerts on a stream: a state machine per rule and series.

A series is idle, pending (it breaches) or firing (it has breached for the rule's hold time). Its state is one row of
numbers, whatever it has seen: when the run began, its newest sample, how many samples, the peak, whether it has fired.
An event-time timer ends a run that has fallen silent and then forgets the series.

With ``groups`` series are gathered by hash into that many groups: the same rows of state are one table per group, read and written
once a batch, and all series of a group are worked on at once. That is what many small series need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.slices import names
from tidemark.functions.units import micros
from tidemark.operators.alerts import Rule, with_rules
from tidemark.streaming.stateful import _gathered, _packed, _unpacked

_OUT = ["state", "started", "seen", "samples", "peak", "hold_s", "severity"]
_RUN = "breached boolean, begun bigint, last bigint, samples bigint, peak double, fired boolean, hold_s bigint, severity string, alarm bigint"


class _Run:
    """The state of one series while a batch is read."""

    def __init__(self, held: tuple | None, hold_s: int, severity: str) -> None:
        self.breached, self.begun, self.last, self.samples, self.peak, self.fired, self.hold_s, self.severity, self.alarm = (
            held or (False, 0, None, 0, 0.0, False, hold_s, severity, None))
        self.out: list[tuple] = []

    def row(self, state: str, seen: int, samples: int, peak: float) -> None:
        self.out.append((state, self.begun, seen, samples, peak, self.hold_s, self.severity))

    def end(self) -> None:
        if self.breached and self.fired:
            self.row("resolved", self.last, self.samples, self.peak)
        self.breached, self.fired = False, False

    def breach(self, us: np.ndarray, values: np.ndarray) -> None:
        """Samples that breach, in order, without a gap."""
        if not self.breached:
            self.breached, self.begun, self.samples, self.peak = True, int(us[0]), 0, float("-inf")
        if not self.fired:
            held = us - self.begun >= self.hold_s * 1_000_000
            if held.any():
                first = int(held.argmax())
                self.fired = True
                self.row("firing", int(us[first]), self.samples + first + 1, float(max(self.peak, values[: first + 1].max())))
        self.samples += len(us)
        self.peak = float(max(self.peak, values.max()))

    def read(self, us: np.ndarray, values: np.ndarray, breached: np.ndarray, gap: int) -> None:
        cuts = np.flatnonzero((breached[1:] != breached[:-1]) | (np.diff(us) > gap)) + 1
        bounds = [0, *cuts.tolist(), len(us)]
        for a, b in zip(bounds, bounds[1:]):
            if not breached[a] or (self.last is not None and us[a] - self.last > gap):
                self.end()
            if breached[a]:
                self.breach(us[a:b], values[a:b])
            self.last = int(us[b - 1])

    def kept(self) -> tuple:
        return (self.breached, self.begun, self.last, self.samples, self.peak, self.fired, self.hold_s, self.severity, self.alarm)


class _Sustained(StatefulProcessor):
    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _RUN)

    def _rows(self, key, run: _Run) -> Iterator[pd.DataFrame]:
        if run.out:
            rows = pd.DataFrame(run.out, columns=_OUT)
            rows.insert(0, "k", key[0])
            yield rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True)
        held = self.state.get() if self.state.exists() else None
        run = _Run(held, int(seen["hold_s"].iloc[0]), seen["severity"].iloc[0])
        if run.last is not None:
            seen = seen[seen["us"] >= run.last]
        if not len(seen):
            return
        seen = seen.sort_values(["us", "ord"], kind="stable")
        run.read(seen["us"].to_numpy(np.int64), seen["value"].to_numpy(np.float64), seen["breached"].to_numpy(bool), self.gap)
        at = (run.last + self.gap) // 1000 + 1
        if run.alarm is not None:
            self.handle.deleteTimer(run.alarm)
        self.handle.registerTimer(at)
        run.alarm = at
        self.state.update(run.kept())
        yield from self._rows(key, run)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return
        run = _Run(held, 0, "")
        run.end()
        self.state.clear()
        yield from self._rows(key, run)

    def close(self) -> None:
        pass


_HELD = ["k", "breached", "begun", "last", "samples", "peak", "fired", "hold_s", "severity"]
_HELD_TYPES = {"breached": bool, "begun": np.int64, "last": np.int64, "samples": np.int64, "peak": np.float64, "fired": bool, "hold_s": np.int64}


class _SustainedTogether(_Sustained):
    """The same for a group of series, whose runs are one table in the Arrow format and share one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "runs binary, alarm bigint")

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return pd.DataFrame(columns=_HELD).astype(_HELD_TYPES), None
        return pa.ipc.open_stream(bytes(held[0])).read_all().to_pandas(), held[1]

    def _keep(self, runs: pd.DataFrame, alarm: int | None) -> None:
        if alarm is not None:
            self.handle.deleteTimer(alarm)
        if not len(runs):
            self.state.clear()
            return
        at = (int(runs["last"].min()) + self.gap) // 1000 + 1
        self.handle.registerTimer(at)
        table, sink = pa.Table.from_pandas(runs[_HELD], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), at))

    @staticmethod
    def _out(rows: pd.DataFrame, state: str) -> pd.DataFrame:
        return rows.assign(state=state).rename(columns={"begun": "started"})[["k", *_OUT]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, alarm = self._held()
        seen = pd.concat(list(rows), ignore_index=True)
        code, series = pd.factorize(pd.concat([held["k"], seen["series"]], ignore_index=True))
        known = len(held)  # the first codes are those of the held rows, in their order
        seen["code"] = code[known:]
        last = np.full(len(series), np.iinfo(np.int64).min)
        last[:known] = held["last"]
        seen = seen[seen["us"].to_numpy() >= last[seen["code"].to_numpy()]]
        if not len(seen):
            return
        seen = seen.sort_values(["code", "us", "ord"], kind="stable", ignore_index=True)
        code, us, breached = seen["code"].to_numpy(), seen["us"].to_numpy(np.int64), seen["breached"].to_numpy(bool)
        value = seen["value"].to_numpy(np.float64)
        head = np.r_[True, code[1:] != code[:-1]]
        tail = np.r_[head[1:], True]
        before = held.reindex(code)  # a held run in front of the samples of its series
        has = code < known
        goes_on = head & has & breached
        goes_on[goes_on] = before["breached"].to_numpy()[goes_on].astype(bool) & (us - np.where(has, last[code], us) <= self.gap)[goes_on]
        follows = ~head & np.r_[False, breached[:-1]] & (np.diff(us, prepend=us[0]) <= self.gap)
        start = breached & ~goes_on & ~follows

        # One row per run of the batch, with what the held run brings to it.
        run = np.cumsum(start | goes_on)[breached] - 1
        at = np.flatnonzero(start | goes_on)
        carried = goes_on[at]
        take = lambda name, new, kind: np.where(carried, before[name].to_numpy()[at], new).astype(kind)
        begun, counted = take("begun", us[at], np.int64), take("samples", 0, np.int64)
        peak, fired = take("peak", -np.inf, np.float64), take("fired", False, bool)
        rule = pd.DataFrame({"hold_s": seen["hold_s"], "severity": seen["severity"]})[head].set_index(code[head])
        rule.loc[rule.index < known, ["hold_s", "severity"]] = held.loc[rule.index[rule.index < known], ["hold_s", "severity"]]
        hits = pd.DataFrame({"run": run, "us": us[breached], "value": value[breached], "code": code[breached], "end": tail[breached]})
        hits["samples"] = hits.groupby("run").cumcount().to_numpy() + 1 + counted[run]
        hits["peak"] = np.maximum(hits.groupby("run")["value"].cummax().to_numpy(), peak[run])
        hits["begun"], hits["k"] = begun[run], series[hits["code"]]
        hits["hold_s"], hits["severity"] = rule["hold_s"].reindex(hits["code"]).to_numpy(np.int64), rule["severity"].reindex(hits["code"]).to_numpy()
        hits["seen"] = hits["us"]
        reached = hits[(hits["us"] - hits["begun"] >= hits["hold_s"] * 1_000_000) & ~fired[run]].drop_duplicates("run")
        fired[reached["run"]] = True
        ends = hits.drop_duplicates("run", keep="last")
        over = ends[~ends["end"].to_numpy() & fired[ends["run"]]]

        # A held run that the first sample of its series does not go on with is over.
        first = code[head & has & ~goes_on]
        stopped = held.loc[first][held.loc[first, "breached"].to_numpy(bool) & held.loc[first, "fired"].to_numpy(bool)]
        for out, state in ((reached, "firing"), (over, "resolved"), (stopped.assign(seen=stopped["last"]), "resolved")):
            if len(out):
                yield self._out(out, state)

        now = pd.DataFrame({"k": series[code[tail]], "breached": breached[tail], "last": us[tail]}, index=code[tail])
        open_ = ends[ends["end"]].set_index("code")
        for name, none in (("begun", 0), ("samples", 0), ("peak", 0.0)):
            now[name] = open_[name].reindex(now.index).fillna(none) if name == "peak" else open_[name].reindex(now.index, fill_value=none)
        now["fired"] = pd.Series(fired[open_["run"]], index=open_.index).reindex(now.index, fill_value=False)
        now["hold_s"], now["severity"] = rule["hold_s"], rule["severity"]
        now = now.astype(_HELD_TYPES)
        silent = held.drop(index=now.index[now.index < known])
        self._keep(pd.concat([silent, now], ignore_index=True) if len(silent) else now, alarm)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, alarm = self._held()
        if alarm is None:
            return
        over = held["last"].to_numpy() + self.gap < timerValues.getCurrentWatermarkInMs() * 1000
        ended = held[over & held["breached"].to_numpy(bool) & held["fired"].to_numpy(bool)]
        self._keep(held[~over], None if over.any() else alarm)
        if len(ended):
            yield self._out(ended.assign(seen=ended["last"]), "resolved")


def alert_sustained_stream(
    samples: DataFrame, rules: Sequence[Rule], by: str | Sequence[str], time: str = "ts", value: str = "value",
    max_gap: str | int = "5 minutes", order: str | None = None, groups: int | None = None,
) -> DataFrame:
    """Streaming form of ``alert_sustained``: (rule, by, state, started, seen, samples, peak, hold_s, severity, fired_at).

    A run gives a row ``firing`` with the sample at which the hold time was reached, and, if it did, a row ``resolved`` when it ends:
    at a sample that does not breach, at one after a gap longer than ``max_gap``, or when the watermark has
    passed the gap. ``seen`` is the run's newest sample, ``samples`` and ``peak`` are those up to it. The resolved rows are the rows of
    ``alert_sustained`` for the runs that have ended.

    ``samples`` needs a watermark. Samples of a series come in order from batch to batch, in any order inside one (``order`` breaks
    ties); one that is older than the series' newest is left out, as is one without a time. State is
    one row per rule and series, and none once a series has been silent for ``max_gap``; ``groups`` keeps those of a group together.
    """
    by = names(by)
    keys = ["rule", *by]
    ruled = with_rules(samples.filter(F.col(time).isNotNull()), rules, value)
    # The key is text, in which a null label is no null.
    rows = ruled.select(
        _packed(keys).alias("k"), F.unix_micros(time).alias("us"), (F.col(order) if order else F.lit(0)).cast("long").alias("ord"),
        F.col(value).cast("double").alias("value"), "breached", "hold_s", "severity")
    schema = "k string, state string, started bigint, seen bigint, samples bigint, peak double, hold_s bigint, severity string"
    processor = _Sustained(micros(max_gap))
    if groups is not None:
        rows = rows.withColumnRenamed("k", "series").withColumn("k", _gathered(F.col("series"), groups))
        processor = _SustainedTogether(micros(max_gap))
    out = rows.groupBy("k").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    out = out.select(_unpacked("k", ruled.select(*keys).schema).alias("_k"), *_OUT).select("_k.*", *_OUT)
    return out.withColumns({
        "fired_at": F.timestamp_micros(F.col("started") + F.col("hold_s") * F.lit(1000000)),
        "started": F.timestamp_micros("started"), "seen": F.timestamp_micros("seen"),
    })
