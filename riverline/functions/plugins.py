"""Functions that callers bring: named width methods as Column builders, and Python callbacks in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib.metadata import entry_points

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = "riverline.width_methods"


@dataclass(frozen=True)
class WidthMethod:
    """Builders of Columns from Columns; `breakdown` gives named parts."""

    name: str
    straight: Callable[..., Column]
    bend: Callable[..., Column]
    least_radius: Callable[..., Column]
    breakdown: Callable[..., dict[str, Column]] | None = None


_methods: dict[str, WidthMethod] = {}


def register(method: WidthMethod, replace: bool = False) -> None:
    if method.name in _methods and not replace:
        raise ValueError(f"a width method {method.name!r} is registered already")
    _methods[method.name] = method


def width_method(name: str) -> WidthMethod:
    """A registered method, else one that an installed package offers under GROUP."""
    if name not in _methods:
        found = [e for e in entry_points(group=GROUP) if e.name == name]
        if not found:
            raise KeyError(f"no width method {name!r}; known: {', '.join(sorted(_methods))}")
        register(found[0].load())
    return _methods[name]


def scalar(function: Callable[[np.ndarray], np.ndarray]):
    """A number for each number, whole batches at a time."""

    @F.pandas_udf("double")
    def call(x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(function(x.to_numpy(float)), float))

    return call


def triple(function: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
    """A number for (a, b, level), such as a reach's cost."""

    @F.pandas_udf("double")
    def call(a: pd.Series, b: pd.Series, level: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(function(*(v.to_numpy(float) for v in (a, b, level))), float))

    return call


def text(function: Callable[[float], str | None]):
    """A text for each number, such as a station's tag."""

    @F.pandas_udf("string")
    def call(x: pd.Series) -> pd.Series:
        return pd.Series([function(v) for v in x.to_numpy(float)], dtype=object)

    return call


def heights(points: DataFrame, function: Callable[[np.ndarray, np.ndarray], np.ndarray], x: str = "x", y: str = "y", name: str = "z") -> DataFrame:
    """points with a height for each (x, y); NaN comes back as null. The function gets whole Arrow batches."""
    columns = points.columns

    def work(batches):
        for batch in batches:
            z = np.asarray(function(*(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (x, y))), float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(z, mask=~np.isfinite(z))], names=[*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(work, f"{fields}, {name} double")


def over_jobs(jobs: DataFrame, solve: Callable[[dict], dict], schema: str) -> DataFrame:
    """solve for each row, a task's rows one after the other; answers come with the job's own columns in their order."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = jobs.columns

    def work(batches):
        for batch in batches:
            found = [solve(r) for r in batch.to_pylist()]
            answers = [pa.array([f[n] for f in found]) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *answers], names=[*columns, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    return jobs.mapInArrow(work, f"{fields}, {schema}")
