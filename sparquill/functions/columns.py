"""Column functions on points, boxes, transforms and short arrays, all inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of the transform checks and the score's weights.
LEAST_SINGULAR, MOST_SINGULAR, MOST_ANISOTROPY = 50.0, 6000.0, 8.0
WEIGHTS = {"presence": 0.25, "localization": 0.2, "recovery": 0.25, "identification": 0.3}


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def distance_reward(d: Column) -> Column:
    """1 up to 12 pixels, 0 from 36, linear between."""
    return clip((F.lit(36.0) - d) / 24.0, 0.0, 1.0)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def bucket(x: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The name of the first edge that x does not pass, or ``last``."""
    out = F.lit(last)
    for most, name in reversed(edges):
        out = F.when(x <= most, F.lit(name)).otherwise(out)
    return out


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Half-open boxes (x0, y0, x1, y1) that share area."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def singular_values(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Of the matrix [[a, b], [c, d]], the larger first."""
    total, det = a * a + b * b + c * c + d * d, F.abs(a * d - b * c)
    large = F.sqrt((total + F.sqrt(F.greatest(F.lit(0.0), total * total - 4 * det * det))) / 2)
    return large, F.when(large > 0, det / large).otherwise(0.0)


def valid_transform(a: Column, b: Column, c: Column, d: Column, low: float = LEAST_SINGULAR, high: float = MOST_SINGULAR, ratio: float = MOST_ANISOTROPY) -> Column:
    large, small = singular_values(a, b, c, d)
    finite = ~(F.isnan(large) | F.isnan(small))
    return finite & (small >= low) & (large <= high) & (large <= ratio * small)


def shear(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cosine of the angle between the rows, without sign."""
    return F.abs(a * c + b * d) / (F.sqrt(a * a + b * b) * F.sqrt(c * c + d * d))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_centred(v: Column) -> Column:
    """A vector less its mean, of unit length; lengths count as 1e-6 at least."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    centred = lambda m: F.transform(v, lambda x: x - m)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return once(mean, lambda m: once(centred(m), lambda c: once(norm(c), lambda n: F.transform(c, lambda x: x / F.greatest(n, F.lit(1e-6))))))


def once(value: Column, use) -> Column:
    """``use`` of a value computed once a row, also where ``use`` has it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k, summed."""
    return F.when(k < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i)))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P[X > k] for X ~ Bin(n, p), strictly greater; 1 for a negative k."""
    low = F.greatest(k.cast("int") + 1, F.lit(0))
    term = lambda i: F.exp(log_choose(n, i) + i * F.log(p) + (n - i) * F.log(1 - p))
    return F.when(k < 0, F.lit(1.0)).when(k >= n, F.lit(0.0)).otherwise(F.aggregate(F.sequence(low, n.cast("int")), F.lit(0.0), lambda s, i: s + term(i)))


def surprise(support: Column, nodes: Column, density: Column, tolerance: float, least_support: int = 4) -> Column:
    """-log10 of the chance that as many nodes meet points by accident in a field of 9e6 square pixels."""
    p = F.least(F.lit(0.8), density * math.pi * tolerance * tolerance / 9e6)
    return -F.log10(binomial_tail(support - least_support, F.greatest(nodes - 3, F.lit(1)), p))


#: Fixed value: what the fewer parameters of a similarity are worth.
SIMILARITY_BONUS = 0.35


def hypothesis_score(evidence: Column, residual: Column, skew: Column, appearance: Column, rank_cost: Column, similar: Column, tolerance: float, shear_penalty: float, appearance_weight: float, rank_weight: float) -> Column:
    """A fit's score: its evidence less half its mean residual by the tolerance and its shear, with what appearance and rank add."""
    bonus = F.when(similar, SIMILARITY_BONUS).otherwise(0.0)
    return evidence - 0.5 * residual / tolerance + bonus - shear_penalty * skew + appearance_weight * appearance - rank_weight * rank_cost


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) that depends on the seed and the keys alone: the first 52 bits of a hash."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def likelihood(residuals: Column, tolerance: float, sigma: float) -> Column:
    """Sum of the log-ratios of a Gaussian to a uniform disc over residuals."""
    base = math.log(tolerance * tolerance / (2 * sigma * sigma))
    return F.aggregate(residuals, F.lit(0.0), lambda s, r: s + F.lit(base) - r * r / (2 * sigma * sigma))


def trimmed_mean(v: Column, share: float) -> Column:
    """Mean of an array without its largest ``share``."""
    keep = F.greatest(F.lit(1), F.floor(F.size(v) * (1 - share)).cast("int"))
    return F.aggregate(F.slice(F.array_sort(v), F.lit(1), keep), F.lit(0.0), lambda s, x: s + x) / keep


def parse_cell(cell: Column) -> Column:
    """``(x, y, m)`` as a struct, null for ``-1``; raises for any other text, a non-finite number or m outside 0 and 1."""
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    form = rf"^\s*\(\s*({number})\s*,\s*({number})\s*,\s*([01])\s*\)\s*$"
    got = F.struct(*(F.regexp_extract(cell, form, i).cast(t).alias(n) for i, (n, t) in enumerate((("x", "double"), ("y", "double"), ("member", "int")), 1)))
    none = F.lit(None).cast("struct<x:double,y:double,member:int>")
    return F.when(cell.isNull() | (F.trim(cell) == "-1"), none).when(cell.rlike(form), got).otherwise(F.raise_error(F.concat(F.lit("no cell: "), cell)).cast("struct<x:double,y:double,member:int>"))


def format_cell(x: Column, y: Column, member: Column) -> Column:
    """``(x,y,m)`` with three decimals, ``-1`` for a null."""
    three = lambda v: F.format_string("%.3f", v)
    return F.when(x.isNull(), F.lit("-1")).otherwise(F.concat(F.lit("("), three(x), F.lit(", "), three(y), F.lit(", "), member.cast("string"), F.lit(")")))
