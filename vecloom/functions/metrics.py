"""Distances, each as a Column expression and as a numpy kernel between two sets of vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """column(a, b): of two array columns. kernel(x, y): the table of distances between lists of vectors. Where a distance isn't
    defined the column is null and the kernel NaN, which no search ranks.

    exact(x, y), where given, has distances of vectors in pairs without the kernel's rounding, which is less than rounding(norm) for vectors of
    that norm at most. A metric that isn't ragged compares vectors of one length, and searches raise ValueError where others meet.
    factors(x, y), where given, has two tables, a row a vector, whose product is the kernel's table, or its square where `squared`.
    """

    name: str
    column: Callable[[Column, Column], Column]
    kernel: Callable[[list, list], np.ndarray]
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    ragged: bool = True
    rounding: Callable[[float], float] = lambda norm: 1e-6 * (1 + norm)
    factors: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None
    squared: bool = False


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def inner_product(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 0 between two zero vectors, 1 if only one is zero."""
    na, nb = inner_product(a, a), inner_product(b, b)
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1.0 - inner_product(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of places whose values aren't 0; 0 between two empty sets."""
    count = lambda f: _fold(F.zip_with(a, b, lambda x, y: F.when(f(x != 0, y != 0), 1.0).otherwise(0.0)))
    union, both = count(lambda x, y: x | y), count(lambda x, y: x & y)
    return F.when(union == 0, 0.0).otherwise((union - both) / union)


def projected(a: Column, b: Column) -> Column:
    """Distance of the first coordinates; vectors may differ in length. Null with an empty vector."""
    return F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0)))


def cos_sim_squared(a: Column, b: Column) -> Column:
    """The squared cosine similarity; null with a zero vector. It is a similarity: ranked like a distance it puts orthogonal vectors first."""
    dot, norms = inner_product(a, b), inner_product(a, a) * inner_product(b, b)
    return F.when(norms != 0, dot * dot / norms)


def multiply_accumulate(out: Column, factor: Column | float, values: Column) -> Column:
    """out + factor * values, place by place."""
    by = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.zip_with(out, values, lambda o, v: o + by * v)


def nearly_equal(a: Column, b: Column, epsilon: float = float(np.finfo(np.float64).eps)) -> Column:
    return F.abs(a - b) < epsilon


def _k_squared(x: list, y: list) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    d = (-2 * x) @ y.T
    d += (x * x).sum(1)[:, None]
    d += (y * y).sum(1)
    return np.maximum(d, 0, out=d)


def _f_squared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ones = lambda v: np.ones((len(v), 1))
    return np.hstack([-2 * x, (x * x).sum(1)[:, None], ones(x)]), np.hstack([y, ones(y), (y * y).sum(1)[:, None]])


def _f_cosine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two zero vectors meet in a column of their own, which takes the 1 away."""

    def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.linalg.norm(v, axis=1)[:, None]
        return v / np.where(norm == 0, 1.0, norm), (norm == 0).astype(float)

    (x, no_x), (y, no_y) = unit(x), unit(y)
    return np.hstack([-x, np.ones_like(no_x), -no_x]), np.hstack([y, np.ones_like(no_y), no_y])


def _k_cosine(x: list, y: list) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    nx, ny = np.linalg.norm(x, axis=1)[:, None], np.linalg.norm(y, axis=1)[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        d = 1 - (x @ y.T) / (nx * ny)
    return np.where((nx == 0) & (ny == 0), 0.0, np.where((nx == 0) | (ny == 0), 1.0, d))


def _k_jaccard(x: list, y: list) -> np.ndarray:
    x, y = (np.asarray(x) != 0).astype(float), (np.asarray(y) != 0).astype(float)
    both = x @ y.T
    union = x.sum(1)[:, None] + y.sum(1) - both
    return np.where(union == 0, 0.0, (union - both) / np.where(union == 0, 1, union))


def _k_projected(x: list, y: list) -> np.ndarray:
    first = lambda vectors: np.array([v[0] if len(v) else np.nan for v in vectors], float)
    return np.abs(first(x)[:, None] - first(y))


def _k_cos_sim_squared(x: list, y: list) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x @ y.T) ** 2 / ((x * x).sum(1)[:, None] * (y * y).sum(1))


_METRICS: dict[str, Metric] = {}


def register_metric(name: str, column: Callable[[Column, Column], Column], kernel: Callable[[list, list], np.ndarray], exact: Callable | None = None, ragged: bool = True, rounding: Callable[[float], float] = lambda norm: 1e-6 * (1 + norm), factors: Callable | None = None, squared: bool = False) -> Metric:
    """Makes a user's distance known by name, as a Column builder and a kernel."""
    _METRICS[name] = Metric(name, column, kernel, exact, ragged, rounding, factors, squared)
    return _METRICS[name]


def register_function_metric(name: str, distance: Callable[[np.ndarray, np.ndarray], float | None], many: bool = False) -> Metric:
    """Makes a user's Python function of two vectors known as a distance: in searches a kernel calls it, in Columns an Arrow function.

    It is called once a pair, unless it takes `many`: then it gets a vector and a table of vectors of that length, a row each, and returns their distances, so
    numpy does what Python would do a pair at a time. Two vectors are given as they are where lengths differ. None, or what it isn't defined for,
    as NaN, never ranks.
    """

    def kernel(x: list, y: list) -> np.ndarray:
        if many and isinstance(x, np.ndarray) and isinstance(y, np.ndarray):
            return np.array([np.broadcast_to(distance(a, y), len(y)) for a in x], float).reshape(len(x), len(y))
        x, y = ([np.asarray(v, float) for v in side] for side in (x, y))
        return np.array([[single(a, b) for b in y] for a in x], float).reshape(len(x), len(y))

    def single(a: np.ndarray, b: np.ndarray) -> float:
        d = distance(a, b[None])[0] if many and len(a) == len(b) else distance(a, b)
        return np.nan if d is None else float(d)

    def column(a: Column, b: Column) -> Column:
        def each(x, y):
            return pd.Series([None if p is None or q is None else single(np.asarray(p, float), np.asarray(q, float)) for p, q in zip(x, y, strict=True)], dtype="float64")

        each.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
        return F.pandas_udf(each, "double")(a, b)

    return register_metric(name, column, kernel)


def _k_l2(x: list, y: list) -> np.ndarray:
    d = _k_squared(x, y)
    return np.sqrt(d, out=d)


register_metric("l2", l2, _k_l2, lambda x, y: np.sqrt(((x - y) ** 2).sum(-1)), ragged=False, rounding=lambda norm: 1e-6 * norm, factors=_f_squared, squared=True)
register_metric("sql2", squared_l2, _k_squared, lambda x, y: ((x - y) ** 2).sum(-1), ragged=False, rounding=lambda norm: 1e-12 * norm * norm, factors=_f_squared)
register_metric("cosine", cosine, _k_cosine, ragged=False, factors=_f_cosine)
register_metric("jaccard", jaccard, _k_jaccard, ragged=False)
register_metric("projected", projected, _k_projected)
register_metric("cos_sim_squared", cos_sim_squared, _k_cos_sim_squared, ragged=False)


def metric(name: str | Metric) -> Metric:
    """The metric of that name; ValueError if there is none."""
    if isinstance(name, Metric):
        return name
    if name not in _METRICS:
        raise ValueError(f"no metric {name!r}; known: {', '.join(sorted(_METRICS))}")
    return _METRICS[name]
