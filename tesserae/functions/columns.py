"""Numeric Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean_above(value: Column, bound: int) -> Column:
    """Aggregate: avg(value) > bound, which does not depend on the order of the rows. Sums of doubles do: where the mean of
    decimal values is the bound itself, one order ends above it and another below. So values are added as the decimals that
    they are written as; a group with a value that no decimal(38, 18) holds (infinite, NaN, too large or too fine) is
    compared by its average."""
    exact = value.try_cast("decimal(38,18)")
    held = F.bool_and(F.coalesce(exact.cast("double") == value, value.isNull()))
    total = F.try_sum(exact)
    return F.when(held & total.isNotNull(), total > F.lit(bound) * F.count(value)).otherwise(F.avg(value) > bound)


def log2_or_inf(x: Column) -> Column:
    """log2 with -inf at 0 and NaN below, where Spark's own gives null."""
    return F.when(x > 0, F.log2(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def clip(x: Column, most: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(most))), F.lit(-float(most)))


def log_factorial(n: Column) -> Column:
    """ln n! for doubles n of 0 or more: Stirling's series at n + 9, less the logarithm of the nine factors between."""
    x = n + 10.0
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    between = n + 1.0
    for k in range(2, 10):
        between = between * (n + float(k))
    return series - F.ln(between)


#: Rational approximations of erf and erfc by Cody (1969); fixed published values, highest power first.
_P1 = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_Q1 = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_P2 = (-1.368648573827167067e-7, 5.641955174789739711e-1, 7.211758250883093659, 4.316222722205673530e1, 1.529892850469404039e2, 3.393208167343436870e2, 4.519189537118729422e2, 3.004592610201616005e2)
_Q2 = (1.0, 1.278272731962942351e1, 7.700015293522947295e1, 2.775854447439876434e2, 6.389802644656311665e2, 9.313540948506096211e2, 7.909509253278980272e2, 3.004592609569832933e2)
_P3 = (2.23192459734184686e-2, 2.78661308609647788e-1, 2.26956593539686930e-1, 4.94730910623250734e-2, 2.99610707703542174e-3)
_Q3 = (1.0, 1.98733201817135256, 1.05167510706793207, 1.91308926107829841e-1, 1.06209230528467918e-2)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def erfc_sql(x: str) -> str:
    """erfc of the SQL expression `x` (not below 0), in words that Spark and DuckDB both read."""
    sq, inv = f"({x} * {x})", f"(1.0 / ({x} * {x}))"
    near = f"(1.0 - {x} * {_horner(_P1, sq)} / {_horner(_Q1, sq)})"
    mid = f"(exp(-{sq}) * {_horner(_P2, x)} / {_horner(_Q2, x)})"
    tail = f"(exp(-{sq}) / {x} * (0.5641895835477563 - {inv} * {_horner(_P3, inv)} / {_horner(_Q3, inv)}))"
    return f"CASE WHEN {x} < 0.46875 THEN {near} WHEN {x} <= 4.0 THEN {mid} ELSE {tail} END"


def normal_two_sided(z: str) -> str:
    """2 * P(Z > |z|)."""
    return f"({erfc_sql(f'(abs({z}) / 1.4142135623730951)')})"
