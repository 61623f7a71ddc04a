"""Domains and panels: long-form (time DATE, asset_id STRING, value) DataFrames bound to a calendar and a universe."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import nn

KEYS = ("time", "asset_id")


class PanelError(ValueError):
    """Data do not fit the panel's rules."""


def date_column(df: DataFrame, name: str = "time"):
    kind = dict(df.dtypes)[name]
    return F.expr(f"try_to_date({name}, 'yyyy-MM-dd')") if kind == "string" else F.expr(f"try_cast({name} as date)")


def align_frames(*frames: DataFrame, join: str = "inner") -> tuple[DataFrame, ...]:
    """The frames on their common keys (inner: semi-joins, no frame is widened) or on the keys of any of them (outer: rows that a frame lacks are null)."""
    if join not in ("inner", "outer"):
        raise ValueError("join must be inner or outer")
    if len(frames) < 2:
        return frames
    keys = [f.select(*KEYS) for f in frames]
    if join == "inner":
        return tuple(reduce(lambda f, k: f.join(k, list(KEYS), "leftsemi"), keys[:i] + keys[i + 1 :], f) for i, f in enumerate(frames))
    every = reduce(DataFrame.union, keys).distinct()
    return tuple(every.join(f, list(KEYS), "left") for f in frames)


class Domain:
    """A calendar and a universe, static (all pairs) or dynamic (the active pairs of membership).

    calendar and universe are lists or one-column DataFrames; membership has time, asset_id, active.
    """

    def __init__(self, spark: SparkSession, calendar, universe=None, *, membership: DataFrame | None = None, identity: str | None = None):
        self.spark = spark
        self.calendar = self._keys(calendar, "time", "date").dropna().distinct()
        if membership is not None:
            m = membership.select(date_column(membership).alias("time"), F.col("asset_id").cast("string").alias("asset_id"), "active")
            self._active = m.where("active").select(*KEYS).join(F.broadcast(self.calendar), "time", "leftsemi")
            universe = m.select("asset_id").distinct() if universe is None else universe
        else:
            self._active = None
        self.universe = self._keys(universe, "asset_id", "string").dropna().distinct()
        self._identity = identity
        self.source: DataFrame | None = None

    def _keys(self, values, name: str, kind: str) -> DataFrame:
        if isinstance(values, DataFrame):
            first = values.columns[0]
            renamed = values.select(F.col(first).alias(name))
        else:
            renamed = self.spark.createDataFrame([(str(v),) for v in values], f"{name} string")
        return renamed.select(date_column(renamed).alias(name)) if kind == "date" else renamed.select(F.col(name).cast("string").alias(name))

    @classmethod
    def of(cls, frame: DataFrame, *, identity: str | None = None) -> Domain:
        """The dates and assets that occur in a frame."""
        domain = cls(frame.sparkSession, frame.select("time"), frame.select("asset_id"), identity=identity)
        domain.source = frame
        return domain

    @property
    def is_dynamic(self) -> bool:
        return self._active is not None

    def times(self) -> list:
        """Sorted sessions (a calendar is small by nature: thousands of dates)."""
        return [r["time"] for r in self.calendar.orderBy("time").collect()]

    def asset_ids(self) -> list[str]:
        return [r["asset_id"] for r in self.universe.orderBy("asset_id").collect()]

    def grid(self) -> DataFrame:
        """All active keys. The calendar is the small side of the product."""
        if self.is_dynamic:
            return self._active
        return self.universe.crossJoin(F.broadcast(self.calendar)).select(*KEYS)

    def size(self) -> int:
        return self._active.count() if self.is_dynamic else self.calendar.count() * self.universe.count()

    def membership(self) -> DataFrame:
        every = self.universe.crossJoin(F.broadcast(self.calendar)).select(*KEYS)
        active = self.grid().withColumn("active", F.lit(True))
        return every.join(active, list(KEYS), "left").withColumn("active", F.coalesce("active", F.lit(False)))

    def empty_frame(self) -> DataFrame:
        return self.grid().withColumn("value", F.lit(None).cast("double"))

    def align(self, frame: DataFrame) -> DataFrame:
        return self.grid().join(frame, list(KEYS), "left")

    def restrict(self, frame: DataFrame) -> DataFrame:
        if self.is_dynamic:
            return frame.join(self._active, list(KEYS), "leftsemi")
        return frame.join(F.broadcast(self.calendar), "time", "leftsemi").join(self.universe, "asset_id", "leftsemi")

    def shifted(self, periods: int) -> DataFrame:
        """time -> to: the session that lies `periods` sessions later. A window over the calendar alone."""
        order = W.orderBy("time")
        moved = F.lead("time", periods) if periods >= 0 else F.lag("time", -periods)
        return self.calendar.withColumn("to", moved.over(order)).where("to is not null")

    def signature(self) -> str:
        """Counts and hash sums of the keys: aggregations, whatever the size of the universe."""
        if self._identity is None:
            parts = [self.calendar, self.universe, *([self._active] if self.is_dynamic else [])]
            sums = [p.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*p.columns).cast("decimal(38,0)")), F.sum(F.crc32(F.concat_ws("|", *p.columns)))).first() for p in parts]
            self._identity = hashlib.sha256(json.dumps([[str(x) for x in r] for r in sums]).encode()).hexdigest()
        return self._identity

    def equivalent_to(self, other: Domain) -> bool:
        return self is other or self.signature() == other.signature()


class Panel:
    """An immutable numeric panel. Traces are extra columns that operators carry along."""

    value_type = "double"

    def __init__(self, frame: DataFrame, domain: Domain, *, traces: Sequence[str] = (), identity: str | None = None, dense: bool = False):
        """dense: frame has a row for every active key of the domain."""
        self.frame, self.domain, self.trace_columns, self.dense = frame, domain, tuple(traces), dense
        self.identity = identity or f"panel-{id(self):x}"
        self.shared: tuple[DataFrame, str, str] | None = None

    @classmethod
    def from_domain(cls, data: DataFrame, domain: Domain, *, trace_columns: Iterable[str] = (), identity: str | None = None, validate: bool = False) -> Panel:
        """Normalized rows of data that lie in the domain. validate=True checks keys by one aggregation now; otherwise bad keys surface in check()."""
        missing = {*KEYS, "value", *trace_columns} - set(data.columns)
        if missing:
            raise PanelError(f"columns are missing: {sorted(missing)}")
        kind = dict(data.dtypes)["value"]
        if cls.value_type == "double" and (kind in ("string", "boolean", "date", "timestamp", "binary") or kind.startswith(("array", "map", "struct"))):
            raise PanelError(f"a panel needs numbers, not {kind}")
        frame = data.select(date_column(data).alias("time"), F.col("asset_id").cast("string").alias("asset_id"), cls._normal("value").alias("value"), *trace_columns)
        panel = cls(domain.restrict(frame), domain, traces=tuple(trace_columns), identity=identity)
        if validate:
            cls._check(frame)
        return panel

    @classmethod
    def _normal(cls, column: str):
        value = F.col(column).cast(cls.value_type)
        return nn(value) if cls.value_type == "double" else value

    @staticmethod
    def columns_of(data: DataFrame, domain: Domain, kinds: dict[str, type[Panel]], *, identity: str | None = None) -> dict[str, Panel]:
        """A panel for each named column of data. Graphs over them need no join, as they stay columns of one frame."""
        identity = identity or f"columns-{id(data):x}"
        wide = data.select(date_column(data).alias("time"), F.col("asset_id").cast("string").alias("asset_id"), *[kind._normal(c).alias(c) for c, kind in kinds.items()])
        if domain.source is not data:  # else all keys lie in the domain
            wide = domain.restrict(wide)
        out = {}
        for c, kind in kinds.items():
            out[c] = kind(wide.select(*KEYS, F.col(c).alias("value")), domain, identity=f"{identity}-{c}")
            out[c].shared = (wide, identity, c)
        return out

    @staticmethod
    def _check(frame: DataFrame) -> None:
        if not frame.where("time is null or asset_id is null").isEmpty():
            raise PanelError("a key is null")
        if not frame.groupBy(*KEYS).count().where("count > 1").isEmpty():
            raise PanelError("a key occurs twice")

    def check(self) -> Panel:
        self._check(self.frame)
        return self

    @staticmethod
    def align_frames(*frames: DataFrame, join: str = "inner") -> tuple[DataFrame, ...]:
        return align_frames(*frames, join=join)

    def compute(self, **_) -> Panel:
        return self

    def output(self) -> Panel:
        return self

    def lazy(self, *, dense: bool = False, include_traces: bool = False) -> DataFrame:
        frame = self.domain.align(self.frame) if dense and not self.dense else self.frame
        value = nn(F.col("value")) if self.value_type == "double" else F.col("value")
        return frame.select(*KEYS, value.alias("value"), *(self.trace_columns if include_traces else ()))

    def collect(self, *, dense: bool = True, include_traces: bool = False) -> DataFrame:
        """The sorted result; collect or write it as any DataFrame."""
        return self.lazy(dense=dense, include_traces=include_traces).orderBy(*KEYS)


class CategoryPanel(Panel):
    """Labels instead of numbers."""

    value_type = "string"


class PredictionPanel(Panel):
    """Predictions: they may feed the first input of transformers only."""
