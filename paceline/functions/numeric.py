"""Column functions over numbers: pace, age, bins, clean-up and the normal quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pace_min_per_km(seconds: Column, km: Column) -> Column:
    """Minutes per kilometre; null unless the distance is positive."""
    return F.when(km > 0, seconds / 60 / km)


def age_at(year: Column, birth_year: Column) -> Column:
    return (year - birth_year).cast("bigint")


def finite_or(c: Column, default: float = -1.0) -> Column:
    """``default`` in place of null, NaN and both infinities."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf))
    return F.when(bad, F.lit(default)).otherwise(c)


def bin_label(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open bin [start, end) that holds the value, else null."""
    if len(labels) != len(edges) - 1:
        raise ValueError(f"{len(edges) - 1} bins need as many labels, got {len(labels)}")
    out = None
    for start, end, label in zip(edges, edges[1:], labels):
        inside = c >= start
        if not math.isinf(end):
            inside = inside & (c < end)
        else:
            inside = inside & (c < F.lit(math.inf))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def edge_labels(edges: list[float], unit: str = "") -> list[str]:
    """Readable labels for custom bin edges."""

    def text(v: float) -> str:
        return f"{v:g}"

    labels = []
    for start, end in zip(edges, edges[1:]):
        labels.append(f"≥ {text(start)}{unit}" if math.isinf(end) else f"[{text(start)}, {text(end)}){unit}")
    return labels


# The rational approximations of Wichura's AS 241 (1988),
# highest power first.  They give the normal quantile to double precision.
AS241_CENTRAL = (
    [
        2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
        13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608,
    ],
    [
        5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
        5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0,
    ],
)
AS241_MIDDLE = (
    [
        7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
        3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734,
    ],
    [
        1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
        0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0,
    ],
)
AS241_TAIL = (
    [
        2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
        0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772,
    ],
    [
        2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
        0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0,
    ],
)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1."""

    def ratio(tables: tuple[list[float], list[float]], at: Column) -> Column:
        num, den = (F.lit(t[0]) for t in tables)
        for a, b in zip(tables[0][1:], tables[1][1:]):
            num, den = num * at + a, den * at + b
        return num / den

    centred = p - 0.5
    depth = F.sqrt(-F.log(F.least(p, 1 - p)))
    far = F.when(depth <= 5.0, ratio(AS241_MIDDLE, depth - 1.6)).otherwise(ratio(AS241_TAIL, depth - 5.0))
    return (
        F.when(F.abs(centred) <= 0.425, centred * ratio(AS241_CENTRAL, 0.180625 - centred * centred))
        .when(centred < 0, -far)
        .otherwise(far)
    )
