"""Stateful stream operators.

State lives per key in the state store, in time slices of typed rows: what arrives is added as a chunk of its slice, and
a timer or mark reads only the slices that are due. A hot key is spread with ``salts``: its left (or pending) rows
are divided by hash, and the rows that every part needs (versions, resolved marks) go to each part.

With ``groups`` keys are gathered by hash into that many groups, whose state is kept together: calls to the state store and timers
are then per group and not per key, which is what many small keys need. Rows carry their key in front of their columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.slices import names
from tidemark.functions.units import micros

_TIME_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType,
          T.BinaryType, T.DateType)


def _packed(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), _TIME_FORMAT)


def _unpacked(column: str, schema: T.StructType) -> Column:
    """The packed columns again; the one-element explode keeps the text from being parsed once per field."""
    return F.explode(F.array(F.from_json(column, schema, _TIME_FORMAT)))


def _key_text(columns: Sequence[str]) -> Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"})


def _part(columns: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def _every_part(salts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


def _gathered(key: Column, groups: int | None) -> Column:
    """The text that rows are grouped by: their key, or the number of its group."""
    return key if groups is None else F.pmod(F.xxhash64(key), F.lit(groups)).cast("string")


class _Wire:
    """Columns of a table as state holds them: plain types as they are, times as microseconds, all others as JSON."""

    def __init__(self, df: DataFrame, columns: Sequence[str]) -> None:
        self.fields = [df.schema[c] for c in columns]
        self.type = T.StructType([T.StructField(f"c{i}", self._held(f.dataType)) for i, f in enumerate(self.fields)])
        self.keyed = T.StructType([T.StructField("k", T.StringType()), *self.type.fields])

    @staticmethod
    def _held(kind: T.DataType) -> T.DataType:
        if isinstance(kind, _PLAIN):
            return kind
        return T.LongType() if isinstance(kind, T.TimestampType) else T.StringType()

    def pack(self, key: Column | None = None) -> Column:
        """The columns as one struct, behind the ``key`` if one is given."""
        def one(f: T.StructField) -> Column:
            if isinstance(f.dataType, _PLAIN):
                return F.col(f.name)
            return F.unix_micros(f.name) if isinstance(f.dataType, T.TimestampType) else _packed([f.name])

        front = [] if key is None else [key.alias("k")]
        return F.struct(*front, *[one(f).alias(f"c{i}") for i, f in enumerate(self.fields)])

    def none(self, keyed: bool = False) -> Column:
        return F.lit(None).cast(self.keyed if keyed else self.type)

    def out(self, prefix: str) -> list[T.StructField]:
        return _prefixed(prefix, self.type)

    def unpack(self, prefix: str) -> list[Column]:
        def one(i: int, f: T.StructField) -> Column:
            held = F.col(f"{prefix}{i}")
            if isinstance(f.dataType, _PLAIN):
                return held.alias(f.name)
            if isinstance(f.dataType, T.TimestampType):
                return F.timestamp_micros(held).alias(f.name)
            return F.from_json(held, T.StructType([f]), _TIME_FORMAT)[f.name].alias(f.name)

        return [one(i, f) for i, f in enumerate(self.fields)]


def _prefixed(prefix: str, kind: T.StructType) -> list[T.StructField]:
    return [T.StructField(f"{prefix}{i}", f.dataType) for i, f in enumerate(kind.fields)]


def _entry(row: Row, side: str) -> tuple:
    """Structs arrive as mappings; state takes plain tuples only."""
    held = row[side]
    return int(row["us"]), int(row["ord"]), tuple(held.values() if isinstance(held, dict) else held)


class _Slices:
    """Rows of one or more sides held by time slice, each slice in chunks that are written once."""

    def __init__(self, handle: StatefulProcessorHandle, width: int, sides: dict[str, T.StructType]) -> None:
        self.width, self.sides = width, list(sides)
        held = T.StructType([
            T.StructField(name, T.ArrayType(T.StructType([
                T.StructField("us", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("row", kind)])))
            for name, kind in sides.items()])
        self.index = handle.getValueState("slices", "open array<struct<slice: bigint, chunks: int, first: bigint>>")
        self.chunks = handle.getMapState("chunks", "slice bigint, chunk int", held)

    def open(self) -> dict[int, tuple[int, int | None]]:
        """Per slice that holds rows its chunks and the time of the first row of the first side."""
        held = self.index.get()
        return {s: (n, first) for s, n, first in held[0]} if held else {}

    def keep(self, open_: dict[int, tuple[int, int | None]]) -> None:
        if open_:
            self.index.update(([(s, n, first) for s, (n, first) in sorted(open_.items())],))
        else:
            self.index.clear()

    def add(self, open_: dict[int, tuple[int, int | None]], *rows: list[tuple]) -> None:
        by_slice: dict[int, list[list[tuple]]] = {}
        for side, entries in enumerate(rows):
            for entry in entries:
                by_slice.setdefault(entry[0] // self.width, [[] for _ in rows])[side].append(entry)
        for at, chunk in by_slice.items():
            n, first = open_.get(at, (0, None))
            self.chunks.updateValue((at, n), tuple(chunk))
            low = min((e[0] for e in chunk[0]), default=None)
            open_[at] = (n + 1, low if first is None else first if low is None else min(first, low))

    def take(self, open_: dict[int, tuple[int, int | None]], below: int) -> list[list[tuple]]:
        """Remove and return each side's rows before ``below``; only slices that begin before it are read."""
        due: list[list[tuple]] = [[] for _ in self.sides]
        for at in [s for s in open_ if s * self.width < below]:
            n, _ = open_.pop(at)
            rest: list[list[tuple]] = [[] for _ in self.sides]
            for chunk in range(n):
                for side, entries in enumerate(self.chunks.getValue((at, chunk))):
                    for us, order, row in entries:
                        (due if us < below else rest)[side].append((us, order, tuple(row)))
                self.chunks.removeKey((at, chunk))
            if any(rest):
                self.add(open_, *rest)
        return due


class _AsOf(StatefulProcessor):
    """Holds left rows until the watermark passes them, then joins them with the version valid then.

    One timer per key: for the first left row that waits, or for the end of the first slice that holds versions.
    """

    def __init__(self, width: int, left: T.StructType, right: T.StructType) -> None:
        self.width, self.left, self.right = width, left, right

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shape = Row(*[f.name for f in _prefixed("l", self.left) + _prefixed("r", self.right)])
        self.slices = _Slices(handle, self.width, {"left": self.left, "right": self.right})
        self.newest = handle.getValueState("newest", T.StructType([
            T.StructField("us", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("row", self.right)]))
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        left, right = [], []
        for row in rows:
            if row["us"] >= watermark:
                if row["side"] == 1:
                    left.append(_entry(row, "l"))
                else:
                    right.append(_entry(row, "r"))
        if left or right:
            open_ = self.slices.open()
            self.slices.add(open_, left, right)
            self.slices.keep(open_)
            held = self.alarm.get()
            self._wake(open_, held[0] if held else None)
        return iter([])

    def _wake(self, open_: dict[int, tuple[int, int | None]], current: int | None) -> None:
        due = min((first if first is not None else (s + 1) * self.width for s, (_, first) in open_.items()), default=None)
        at = due // 1000 + 1 if due is not None else None
        if at == current:
            return
        if current is not None:
            self.handle.deleteTimer(current)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.alarm.clear()
        open_ = self.slices.open()
        left, right = self.slices.take(open_, timerValues.getCurrentWatermarkInMs() * 1000)
        self.slices.keep(open_)
        self._wake(open_, None)
        held = self.newest.get()
        version = (held[0], held[1], tuple(held[2])) if held else None
        # Equal (time, order) are told apart by their text, so that no run depends on arrival.
        right.sort(key=lambda v: (v[0], v[1], repr(v[2])))
        out, i = [], 0
        for us, _, row in sorted(left, key=lambda r: r[0]):
            while i < len(right) and right[i][0] <= us:
                version, i = right[i], i + 1
            if version is not None:
                out.append(self.shape(*row, *version[2]))
        if right:
            # A late timer may meet a version that is older than the one kept.
            kept = [(held[0], held[1], tuple(held[2]))] if held else []
            self.newest.update(max(right[-1:] + kept, key=lambda v: (v[0], v[1], repr(v[2]))))
        return iter(out)

    def close(self) -> None:
        pass


def _by_key(entries: list[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for entry in entries:
        out.setdefault(entry[2][0], []).append(entry)
    return out


class _AsOfTogether(_AsOf):
    """The same for a group of keys: one timer, one index of slices and one list of newest versions for all of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shape = Row(*[f.name for f in _prefixed("l", T.StructType(self.left.fields[1:])) + _prefixed("r", T.StructType(self.right.fields[1:]))])
        self.slices = _Slices(handle, self.width, {"left": self.left, "right": self.right})
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("versions", T.ArrayType(T.StructType([
            T.StructField("us", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("row", self.right)])))]))
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.alarm.clear()
        open_ = self.slices.open()
        left, right = self.slices.take(open_, timerValues.getCurrentWatermarkInMs() * 1000)
        self.slices.keep(open_)
        self._wake(open_, None)
        held = self.newest.get()
        newest = {row[0]: (us, order, tuple(row)) for us, order, row in held[0]} if held else {}
        waiting, versions, out = _by_key(left), _by_key(right), []
        for k, rows in waiting.items():
            passed = sorted(versions.get(k, ()), key=_place)
            version, i = newest.get(k), 0
            for us, _, row in sorted(rows, key=lambda r: r[0]):
                while i < len(passed) and passed[i][0] <= us:
                    version, i = passed[i], i + 1
                if version is not None:
                    out.append(self.shape(*row[1:], *version[2][1:]))
        for k, passed in versions.items():
            newest[k] = max([*passed, newest[k]] if k in newest else passed, key=_place)
        if versions:
            self.newest.update((list(newest.values()),))
        return iter(out)


def _place(version: tuple) -> tuple:
    """Equal (time, order) are told apart by their text, so that no run depends on arrival."""
    return version[0], version[1], repr(version[2])


def asof_join_stream(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], left_time: str, right_time: str,
    take: Sequence[str] | None = None, order: str | None = None, salts: int = 8, width: str | int = "1 hour", groups: int | None = None,
) -> DataFrame:
    """Streaming form of ``asof_join`` (inner): a left row comes out once the watermark has passed it.

    Both streams need a watermark. Rows older than the watermark are late and ignored. Rows wait in slices of
    ``width``; once the watermark has passed a slice, of all versions up to there the newest is kept, whether or not the key
    has left rows. Rows without a key or time are left out; a null ``order`` comes first. ``groups`` keeps many small keys'
    state together; a slice that is due in part is then written again for the whole group.
    """
    on = names(on)
    take = list(take) if take is not None else [c for c in right.columns if c not in (*on, right_time)]
    rows, versions = _Wire(left, left.columns), _Wire(right, take)

    def known(df: DataFrame, time: str) -> DataFrame:
        present = F.col(time).isNotNull()
        for k in on:
            present &= F.col(k).isNotNull()
        return df.filter(present)

    ranked = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))) if order else F.lit(0).cast("long")
    together = groups is not None
    key = _key_text(on)
    front = key if together else None
    waiting = known(left, left_time).select(
        _gathered(key, groups).alias("k"), _part(left.columns, salts).alias("part"), F.lit(1).alias("side"),
        F.unix_micros(left_time).alias("us"), F.lit(0).cast("long").alias("ord"), rows.pack(front).alias("l"), versions.none(together).alias("r"),
    )
    valid = known(right, right_time).select(
        _gathered(key, groups).alias("k"), _every_part(salts).alias("part"), F.lit(0).alias("side"),
        F.unix_micros(right_time).alias("us"), ranked.alias("ord"), rows.none(together).alias("l"), versions.pack(front).alias("r"),
    )
    processor = _AsOfTogether(micros(width), rows.keyed, versions.keyed) if together else _AsOf(micros(width), rows.type, versions.type)
    joined = waiting.unionByName(valid).groupBy("k", "part").transformWithState(
        processor, T.StructType(rows.out("l") + versions.out("r")), "Append", "EventTime"
    )
    return joined.select(*rows.unpack("l"), *versions.unpack("r"))


class _Gate(StatefulProcessor):
    """Holds rows until a resolved mark at or above them arrives."""

    def __init__(self, width: int, kind: T.StructType) -> None:
        self.width, self.kind = width, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shape = Row(*[f.name for f in _prefixed("l", self.kind)])
        self.slices = _Slices(handle, self.width, {"rows": self.kind})
        self.mark = handle.getValueState("mark", "us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.mark.get()
        before = held[0] if held else None
        mark, fresh = before, []
        for row in rows:
            if row["side"] == 1:
                fresh.append(_entry(row, "l"))
            elif mark is None or row["us"] > mark:
                mark = int(row["us"])
        out = [e for e in fresh if mark is not None and e[0] <= mark]
        rest = [e for e in fresh if mark is None or e[0] > mark]
        open_ = self.slices.open() if rest or mark != before else {}
        if mark != before:
            self.mark.update((mark,))
            out += self.slices.take(open_, mark + 1)[0]
        if rest:
            self.slices.add(open_, rest)
        if rest or mark != before:
            self.slices.keep(open_)
        return (self.shape(*e[2]) for e in out)

    def close(self) -> None:
        pass


class _GateTogether(_Gate):
    """The same for a group of feeds, each row under the mark of its own feed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shape = Row(*[f.name for f in _prefixed("l", T.StructType(self.kind.fields[1:]))])
        self.slices = _Slices(handle, self.width, {"rows": self.kind})
        self.marks = handle.getValueState("marks", "marks array<struct<k: string, us: bigint>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.marks.get()
        marks = dict(map(tuple, held[0])) if held else {}
        risen, fresh = {}, []
        for row in rows:
            entry = _entry(row, "l")
            if row["side"] == 1:
                fresh.append(entry)
            else:
                feed = entry[2][0]
                if entry[0] > risen.get(feed, marks.get(feed, entry[0] - 1)):
                    risen[feed] = entry[0]
        marks |= risen
        open_ = self.slices.open() if fresh or risen else {}
        # Rows that wait are read where some feed's mark has risen to their slice.
        again = self.slices.take(open_, max(risen.values()) + 1)[0] if risen else []
        out, rest = [], []
        for entry in again + fresh:
            feed = entry[2][0]
            (out if feed in marks and entry[0] <= marks[feed] else rest).append(entry)
        if rest:
            self.slices.add(open_, rest)
        if rest or again:
            self.slices.keep(open_)
        if risen:
            self.marks.update((list(marks.items()),))
        return (self.shape(*e[2][1:]) for e in out)


class _LowWater(StatefulProcessor):
    """The least of the newest marks of all feeds, each time it rises."""

    def __init__(self, feeds: Sequence[str]) -> None:
        self.feeds = frozenset(feeds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getMapState("marks", "feed string", "us bigint")
        self.low = handle.getValueState("low", "us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.marks.iterator()}
        newest = dict(held)
        for row in rows:
            feed = row["feed"]
            if feed in self.feeds and (feed not in newest or row["us"] > newest[feed]):
                newest[feed] = int(row["us"])
        for feed, us in newest.items():
            if held.get(feed) != us:
                self.marks.updateValue((feed,), (us,))
        low = self.low.get()[0] if self.low.exists() else None
        if len(newest) == len(self.feeds) and newest and (low is None or min(newest.values()) > low):
            low = min(newest.values())
            self.low.update((low,))
            yield Row(us=low)

    def close(self) -> None:
        pass


def release_resolved_stream(
    rows: DataFrame, resolved: DataFrame, updated: str, mark: str, stream: str | None = None, salts: int = 8,
    rule: str = "feed", feeds: Sequence[str] = (), width: str | int = "1 hour", groups: int | None = None,
) -> DataFrame:
    """Streaming form of ``release_resolved``: rows come out once they are resolved, and wait in slices of ``width``.

    Under ``feed`` the marks of a row's own feed count. Under ``slowest`` the slowest of ``feeds`` decides for all rows: they
    are named beforehand, as a stream cannot know of a feed that has not spoken; one without a mark holds everything, and marks of
    others are ignored. Its marks are reduced to one low-water mark by a single small state, so only
    that is sent to every part. Rows without a time stay out, under ``feed`` also those without a feed.

    ``groups`` keeps many small feeds' state together; rows that wait in slices up to a risen mark are then read for the whole group. Under
    ``slowest``, where all rows have one key, it divides them into that many times ``salts`` parts.
    """
    if rule not in ("slowest", "feed"):
        raise ValueError(f"unknown rule {rule!r}")
    if (rule == "slowest") != bool(feeds) or not stream:
        raise ValueError("`slowest` needs the feeds' names, `feed` takes none, and both need the feeds' column")
    wire = _Wire(rows, rows.columns)
    together = groups is not None and rule == "feed"
    if rule == "slowest":
        salts *= groups or 1
    marks = resolved.select(F.col(stream).cast("string").alias("feed"), F.unix_micros(mark).alias("us")).filter("us IS NOT NULL AND feed IS NOT NULL")
    data = rows.filter(F.col(updated).isNotNull())
    if rule == "slowest":
        key = F.lit("")
        marks = marks.withColumn("every", F.lit(0)).groupBy("every").transformWithState(_LowWater(list(map(str, feeds))), "us bigint", "Append", "None")
    else:
        key = F.col(stream).cast("string")
        data = data.filter(F.col(stream).isNotNull())
    spread = groups if together else None
    feed = F.lit("") if rule == "slowest" else F.col("feed")
    # Under groups a mark is a row of its feed without columns.
    blank = F.struct(feed.alias("k"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in wire.type.fields]) if together else wire.none()
    waiting = data.select(
        _gathered(key, spread).alias("k"), _part(rows.columns, salts).alias("part"), F.lit(1).alias("side"),
        F.unix_micros(updated).alias("us"), F.lit(0).cast("long").alias("ord"), wire.pack(key if together else None).alias("l"),
    )
    gates = marks.select(
        _gathered(feed, spread).alias("k"), _every_part(salts).alias("part"), F.lit(0).alias("side"), "us",
        F.lit(0).cast("long").alias("ord"), blank.alias("l"),
    )
    processor = _GateTogether(micros(width), wire.keyed) if together else _Gate(micros(width), wire.type)
    gated = waiting.unionByName(gates).groupBy("k", "part").transformWithState(processor, T.StructType(wire.out("l")), "Append", "None")
    return gated.select(*wire.unpack("l"))
