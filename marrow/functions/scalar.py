"""Scalar functions on columns. NULL is the only missing value; NaN and infinities become NULL on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are clipped this far from 0 and 1 before their log-odds are taken.
LOGIT_EPS = 1e-6
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Age bands are half-open: a band starts at its edge.
AGE_EDGES = (45, 55, 65)
AGE_LABELS = ("<45", "45-54", "55-64", "65+")


def finite(x: Column) -> Column:
    """NaN and infinities to NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def logit(p: Column, eps: float = LOGIT_EPS) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    """Exponentials are only taken of numbers that are not positive, so none overflows."""
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(F.exp(z) / (F.lit(1.0) + F.exp(z)))


def base_margin(p: Column) -> Column:
    """Log-odds of a base score; one outside (0, 1) is an error."""
    bad = F.raise_error(F.concat(F.lit("base score outside (0, 1): "), p.cast("string"))).cast("double")
    return F.when((p > 0) & (p < 1), F.log(p / (F.lit(1.0) - p))).otherwise(bad)


def float32(x: Column) -> Column:
    """x rounded to single precision, as a double."""
    return x.cast("float").cast("double")


def sigmoid_calibrated(p: Column, a: Column | float, b: Column | float) -> Column:
    """1 / (1 + exp(a p + b)): a curve in p itself, not in its log-odds."""
    a, b = (c if isinstance(c, Column) else F.lit(float(c)) for c in (a, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(a * p + b))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through ascending breakpoints (two array columns), constant beyond both ends."""
    below = F.size(F.filter(xs, lambda v: v <= x))
    last = F.size(xs)
    x0, x1 = F.get(xs, below - 1), F.get(xs, below)
    y0, y1 = F.get(ys, below - 1), F.get(ys, below)
    inner = F.when(x1 == x0, y0).otherwise(F.try_divide(y1 - y0, x1 - x0) * (x - x0) + y0)
    return F.when(x.isNull(), None).when(below == 0, F.get(ys, F.lit(0))).when(below >= last, F.get(ys, last - 1)).otherwise(inner)


def nonconformity(y: Column, p: Column) -> Column:
    return F.lit(1.0) - F.when(y == 1, p).otherwise(F.lit(1.0) - p)


def prediction_set(p: Column, q_hat: Column | float) -> Column:
    """positive, negative or uncertain; an empty set falls back to the likelier label, a tie to positive."""
    q = q_hat if isinstance(q_hat, Column) else F.lit(float(q_hat))
    has_positive, has_negative = (F.lit(1.0) - p) <= q, p <= q
    likelier = F.when(p >= 0.5, "positive").otherwise("negative")
    return F.when(p.isNull(), None).when(has_positive & has_negative, "uncertain").when(has_positive, "positive").when(has_negative, "negative").otherwise(likelier)


def odds(p: Column) -> Column:
    """p / (1 - p); NULL at 1."""
    return F.try_divide(p, F.lit(1.0) - p)


def strip(s: Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def token_to_null(s: Column, token: str = "?") -> Column:
    return F.nullif(s, F.lit(token))


def to_number(s: Column) -> Column:
    """A double, or NULL for text that is no plain decimal number."""
    t = strip(s.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def form_value(s: Column) -> Column:
    """A form's text as a number: true is 1, false is 0, everything else that is no number is missing."""
    t = strip(s)
    return F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(finite(to_number(t)))


def label_equals(c: Column, value) -> Column:
    """1 if equal, else 0; a missing value is 0."""
    return c.eqNullSafe(F.lit(value)).cast("long")


def label_above(c: Column, threshold: float) -> Column:
    """1 if above, else 0; a missing value is 0."""
    return F.coalesce(c > threshold, F.lit(False)).cast("long")


def label_map(c: Column, mapping: dict) -> Column:
    """The mapped label; a value without one, or a missing one, is an error."""
    hit = reduce(lambda out, kv: out.when(c == kv[0], F.lit(kv[1])), mapping.items(), F.when(F.lit(False), F.lit(None).cast("int")))
    bad = F.raise_error(F.concat(F.lit("no label for "), F.coalesce(c.cast("string"), F.lit("NULL")))).cast("int")
    return F.coalesce(hit, bad).cast("long")


def null_where(c: Column, condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), None).otherwise(c)


def age_band(age: Column, edges=AGE_EDGES, labels=AGE_LABELS) -> Column:
    out = F.when(age.isNull(), None)
    for edge, label in zip(edges, labels):
        out = out.when(age < edge, label)
    return out.otherwise(labels[len(edges)])


def code_band(code: Column, bands: dict) -> Column:
    return reduce(lambda out, kv: out.when(code == kv[0], kv[1]), bands.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def significant(x: Column, digits: int = 6) -> Column:
    """x rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def decimals_hold(x: Column, places: int) -> Column:
    """Whether so many decimals represent x."""
    return F.abs(x - F.round(x, places)) < 1e-9


def humanised(name: Column) -> Column:
    """Underscores to blanks, a trailing number set apart, first letter upper case."""
    spaced = strip(F.regexp_replace(F.regexp_replace(name, "_", " "), r"(\D)(\d+)$", "$1 $2"))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 1_000_000)))


def split_last(name: Column, part: int) -> Column:
    """Part 1 or 2 of name around its last underscore; without one, part 1 is empty and part 2 the name."""
    return F.when(name.contains("_"), F.regexp_extract(name, r"^(.*)_([^_]*)$", part)).otherwise(F.lit("") if part == 1 else name)


def bracketed_number(s: Column) -> Column:
    """A number that may stand in brackets; several numbers are an error."""
    bad = F.raise_error(F.concat(F.lit("more than one number: "), s)).cast("double")
    return F.when(s.contains(","), bad).otherwise(to_number(F.regexp_replace(s, r"[\[\]]", "")))
