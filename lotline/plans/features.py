"""Features: named, lazy columns with lineage."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import centered_power, hard_limits
from ..operators.joins import gather
from ..operators.ordered import lag_first


@dataclass(frozen=True)
class Feature:
    """A column expression over a table, with its attributes, base powers and what is known of its values."""

    name: str
    column: Column = field(repr=False, compare=False)
    attrs: dict = field(default_factory=dict, compare=False)
    powers: tuple = field(default=(), compare=False)
    mean: float = field(default=0.0, compare=False)
    dummy: bool = field(default=False, compare=False)
    constant: bool = field(default=False, compare=False)

    @property
    def degree(self) -> int:
        return sum(n for _, n in self.powers) or 1

    @property
    def centre(self) -> float:
        return 0.0 if self.dummy or self.constant else self.mean


def product_name(powers: Counter) -> str:
    return "*".join(n if k == 1 else f"{n}^{k}" for n, k in sorted(powers.items()))


def joined_attrs(a: dict, b: dict) -> dict:
    """Attributes of both operands; where they differ, both values in order."""
    return {k: "_x_".join(sorted({str(d[k]) for d in (a, b) if k in d})) for k in {*a, *b}}


def base_features(df: DataFrame, names: Iterable[str], attrs: dict[str, dict] | None = None) -> list[Feature]:
    """Features of columns, with mean, range and whether 0/1 or constant from one pass."""
    names = list(names)
    row = df.agg(*(f for i, c in enumerate(names) for f in (F.avg(c).alias(f"m{i}"), F.min(c).cast("double").alias(f"l{i}"), F.max(c).cast("double").alias(f"h{i}"), F.count_if(F.col(c).isin(0, 1)).alias(f"d{i}"), F.count(c).alias(f"n{i}")))).first()
    out = []
    for i, c in enumerate(names):
        low, high = row[f"l{i}"], row[f"h{i}"]
        dummy = low == 0 and high == 1 and row[f"d{i}"] == row[f"n{i}"]
        out.append(Feature(c, F.col(c).cast("double"), {"stream": "MAIN", **((attrs or {}).get(c, {}))}, ((c, 1),), row[f"m{i}"] or 0.0, dummy, low == high))
    return out


def interaction(a: Feature, b: Feature) -> Feature:
    """The product of two centred features; 0/1 and constant ones are not centred."""
    powers = Counter(dict(a.powers)) + Counter(dict(b.powers))
    return Feature(product_name(powers), (a.column - a.centre) * (b.column - b.centre), joined_attrs(a.attrs, b.attrs), tuple(sorted(powers.items())), 0.0, a.dummy and b.dummy)


def power_of(a: Feature, p: int) -> Feature:
    return Feature(product_name(Counter({n: k * p for n, k in a.powers})), centered_power(a.column, p, a.centre), dict(a.attrs), tuple((n, k * p) for n, k in a.powers))


def powers_of(a: Feature, most: int = 5) -> list[Feature]:
    return [power_of(a, p) for p in range(2, most + 1)]


def linear_combination(name: str, constant: float, weights: list[float], features: list[Feature]) -> Feature:
    powers = Counter(n for f in features for n, _ in f.powers)
    return Feature(name, sum((w * f.column for w, f in zip(weights, features)), F.lit(constant)), {"stream": "LINCOMB"}, tuple(sorted(powers.items())))


def unary(op: str, function: Callable[[Column], Column], a: Feature) -> Feature:
    return Feature(f"{op}[{a.name}]", function(a.column), dict(a.attrs), a.powers)


def binary(op: str, function: Callable[[Column, Column], Column], a: Feature, b: Feature) -> Feature:
    return Feature(f"{op}[{a.name},{b.name}]", function(a.column, b.column), joined_attrs(a.attrs, b.attrs), tuple(sorted((Counter(dict(a.powers)) + Counter(dict(b.powers))).items())))


def lagged(a: Feature, lag: int, order: list[str], by: list[str], block: int = 1) -> Feature:
    """The feature lag * block rows before; a.name must be a column of the table."""
    return Feature(f"{a.name}[t-{lag}]", lag_first(a.name, order, by, lag, block).cast("double"), {**a.attrs, "lag": str(lag)}, a.powers)


def neighborhood(df: DataFrame, a: Feature, row: str, index: str) -> tuple[DataFrame, Feature]:
    """The feature of the row that an index column names; the table gains a column."""
    name = f"{a.name}[{index}]"
    wide = gather(df.withColumn("__f", a.column), row, index, "__f", name).drop("__f")
    return wide, Feature(name, F.col(f"`{name}`"), {**a.attrs, "neighborhood": index}, a.powers, a.mean)


def fit_powers(fitted: Column, q: int, binary_response: bool, most: int = 3) -> list[Feature]:
    """Centred powers of a fit, as calibrating predictors."""
    f = hard_limits(fitted) if binary_response else fitted
    return [Feature(f"Y_hat_{q}^{p}", centered_power(f, p, 0.5 if binary_response else 0.0), {"stream": "CALIBRATION"}) for p in range(2, most + 1)]


def having(features: Iterable[Feature], attr: str, values: set[str] | None = None) -> list[Feature]:
    return [f for f in features if attr in f.attrs and (values is None or f.attrs[attr] in values)]


def named_like(features: Iterable[Feature], part: str) -> list[Feature]:
    return [f for f in features if part in f.name]


def streams_of(features: Iterable[Feature]) -> dict[str, list[Feature]]:
    out: dict[str, list[Feature]] = {}
    for f in features:
        out.setdefault(f.attrs.get("stream", "MAIN"), []).append(f)
    return out


def is_derived(f: Feature) -> bool:
    """Features of which no further powers are tried."""
    return f.constant or f.dummy or f.degree > 2 or f.name.startswith(("cube", "square", "Y_hat_")) or "neighborhood" in f.attrs


def related(a: Feature, b: Feature) -> bool:
    """Whether both come from one parent or base column."""
    parents = lambda f: set(str(f.attrs.get("parent", "")).split("_x_")) - {""} | {n for n, _ in f.powers}
    return bool(parents(a) & parents(b))


def same_parent_levels(a: Feature, b: Feature) -> bool:
    """Indicators of different levels of one field: their product is zero."""
    return a.attrs.get("parent") is not None and a.attrs.get("parent") == b.attrs.get("parent") and a.attrs.get("category", 0) != b.attrs.get("category", 0)
