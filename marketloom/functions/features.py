"""Feature registry: declared inputs, dependencies and lookback; one job computes any set of them.

A feature is a function of a `Line` (window helper) that returns a Column. Features may build on
others; `compute` orders them into levels, adds one projection for each level (windows of one
frame then share a node), and runs them in halo blocks, so that a long history of one instrument
spreads over tasks. A recursion (y = a y_before + b) is a feature too: it runs as an affine scan
between windows that it builds on and windows that build on it. User features register the same
way; `streaming.feature_stream` runs any set of them incrementally.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators import scan
from marketloom.schemas import KEY, ORDER


class Line:
    """Windows over one instrument's rows in time order, optionally inside one more key."""

    def __init__(self, *more: str):
        self.base = Window.partitionBy(KEY, *more).orderBy(*ORDER)

    def rows(self, n: int):
        """The last n rows with the present one."""
        return self.base.rowsBetween(1 - n, 0)

    def prior(self, n: int):
        """The n rows before the present one."""
        return self.base.rowsBetween(-n, -1)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(c, n).over(self.base)

    def full(self, n: int, value: Column, on) -> Column:
        """An aggregate over the last n rows, null until n values are there."""
        return F.when(F.count(on).over(self.rows(n)) >= n, value.over(self.rows(n)))

    def full_prior(self, n: int, value: Column, on) -> Column:
        return F.when(F.count(on).over(self.prior(n)) >= n, value.over(self.prior(n)))


@dataclass(frozen=True)
class Feature:
    name: str
    fn: Callable[[Line], Column]
    deps: tuple[str, ...] = ()
    lookback: int = 0
    inputs: tuple[str, ...] = ()
    group: str = "default"
    version: int = 1


@dataclass(frozen=True)
class Recursion(Feature):
    """y = a * y_before + b; `fn` gives b, and `start` the first value (where b isn't null). A row
    whose b is null keeps y."""

    a: Callable[[Line], Column] | None = None
    start: Callable[[Line], Column] | None = None

    def parts(self, line: Line) -> dict[str, Column]:
        return {f"{self.name}_{k}": f(line).cast("double") for k, f in (("a0", self.a), ("b0", self.fn), ("s0", self.start or self.fn))}


@dataclass(frozen=True)
class Grouped(Feature):
    """A user's function of arrays: `arrays` gets the columns in `inputs` and `deps` of one block's
    rows in time order, as numpy arrays, and gives a double for each row. It must not look further
    back than `lookback` rows, so that blocks can be cut anywhere."""

    arrays: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None


def _grouped(f: Grouped) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ORDER])
        made = f.arrays({c: table.column(c).to_numpy(zero_copy_only=False) for c in (*f.inputs, *f.deps)})
        return table.append_column(f.name, pa.array(np.asarray(made, float), from_pandas=True))

    return run


class Registry:
    def __init__(self):
        self.known: dict[str, Feature] = {}

    def add(self, name: str, fn: Callable[[Line], Column], deps=(), lookback: int = 0, inputs=(), group: str = "default", version: int = 1) -> Feature:
        if name in self.known:
            raise ValueError(f"feature {name!r} is registered already")
        self.known[name] = Feature(name, fn, tuple(deps), lookback, tuple(inputs), group, version)
        return self.known[name]

    def add_recursion(self, name: str, a: Callable[[Line], Column], b: Callable[[Line], Column], start: Callable[[Line], Column] | None = None, deps=(), lookback: int = 0, inputs=(), group: str = "default", version: int = 1) -> Feature:
        if name in self.known:
            raise ValueError(f"feature {name!r} is registered already")
        self.known[name] = Recursion(name, b, tuple(deps), lookback, tuple(inputs), group, version, a, start)
        return self.known[name]

    def add_ema(self, name: str, column: str, span: int, deps=(), inputs=(), group: str = "default", version: int = 1) -> Feature:
        """Exponential mean with alpha 2 / (span + 1), seeded with the first value."""
        alpha = 2 / (span + 1)
        return self.add_recursion(name, lambda _: F.lit(1 - alpha), lambda _: F.col(column) * alpha, lambda _: F.col(column), deps, 0, inputs, group, version)

    def add_grouped(self, name: str, arrays: Callable[[dict[str, np.ndarray]], np.ndarray], lookback: int, inputs=(), deps=(), group: str = "default", version: int = 1) -> Feature:
        """A user's function of numpy arrays with a declared lookback; NaN stands for null."""
        if name in self.known:
            raise ValueError(f"feature {name!r} is registered already")
        self.known[name] = Grouped(name, lambda _: F.lit(None), tuple(deps), lookback, tuple(inputs), group, version, arrays)
        return self.known[name]

    def stages(self, names: list[str]) -> list[list[list[str]]]:
        """Levels in stages, windows in even ones and recursions in odd ones: a stage builds on
        earlier stages only, or on windows of its own."""
        levels = self.levels(names)
        rank: dict[str, int] = {}
        for level in levels:
            for n in level:
                own = isinstance(self.known[n], Recursion)
                rank[n] = max([rank[d] + (own or rank[d] % 2) for d in self.known[n].deps], default=0)
                rank[n] += own and rank[n] % 2 == 0
        kept = [[[n for n in level if rank[n] == k] for level in levels] for k in range(max(rank.values(), default=-1) + 1)]
        return [[level for level in stage if level] for stage in kept]

    def levels(self, names: list[str]) -> list[list[str]]:
        """The features and all that they build on, in levels of equal depth."""
        depth: dict[str, int] = {}

        def visit(name: str, path: tuple[str, ...]) -> int:
            if name in path:
                raise ValueError("features build on each other: " + " -> ".join((*path, name)))
            if name not in self.known:
                raise KeyError(f"unknown feature {name!r}")
            if name not in depth:
                depth[name] = 1 + max((visit(d, (*path, name)) for d in self.known[name].deps), default=-1)
            return depth[name]

        for name in names:
            visit(name, ())
        return [sorted(n for n, d in depth.items() if d == k) for k in range(max(depth.values(), default=-1) + 1)]

    def lookback(self, name: str) -> int:
        """Rows before the present one that a feature reaches through all windows that it builds
        on; what comes before a recursion is in its value."""
        f = self.known[name]
        return f.lookback + max((self.lookback(d) for d in f.deps if not isinstance(self.known[d], Recursion)), default=0)

    def inputs(self, names: list[str]) -> list[str]:
        return sorted({c for level in self.levels(names) for n in level for c in self.known[n].inputs})

    def layered(self, df: DataFrame, names: list[str], *more: str) -> DataFrame:
        """df with the features, one projection for each level, windows inside `more` keys too."""
        return self.windows(df, self.levels(names), *more)

    def windows(self, df: DataFrame, levels: list[list[str]], *more: str) -> DataFrame:
        """df with the levels' windows, and with the parts of recursions among them."""
        line = Line(*more)
        for level in levels:
            made = {n: f for n in level if (f"{n}_a0" if isinstance(f := self.known[n], Recursion) else n) not in df.columns}
            df = df.withColumns({c: x for n, f in made.items() if not isinstance(f, Grouped) for c, x in (f.parts(line) if isinstance(f, Recursion) else {n: f.fn(line)}).items()})
            for f in made.values():
                if isinstance(f, Grouped):
                    df = df.groupBy(KEY, *more).applyInArrow(_grouped(f), T.StructType([*df.schema.fields, T.StructField(f.name, T.DoubleType())]))
        return df

    def compute(self, df: DataFrame, names: list[str], reset: str | None = None, block: int = scan.BLOCK) -> DataFrame:
        """df with the named features. With `reset` (such as trading_date) state starts afresh
        with each value of that column, and its values are the blocks; recursions don't reset."""
        keep = [*df.columns, *names]
        if reset:
            if len(self.stages(names)) > 1:
                raise ValueError("recursions don't reset")
            return self.layered(df, names, reset).select(*keep)
        for k, levels in enumerate(self.stages(names)):
            far = max((self.lookback(n) for level in levels for n in level), default=0)
            blocks = far or any(isinstance(self.known[n], Grouped) for level in levels for n in level)
            if levels:
                df = scan.home(self.windows(scan.halo(df, far, block=block), levels, "block_")) if blocks else self.windows(df, levels)
            if k % 2:
                df = scan.recursions(df, [n for level in levels for n in level], block=block)
        return df.select(*keep)


REGISTRY = Registry()
