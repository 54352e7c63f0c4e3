"""Scalar column expressions. Null means undefined; no function fills in a missing input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quantize(value: Column | str, digits: int = 6) -> Column:
    """Round to a grid by floor, which agrees across engines where round() does not.

    The cut lies just off the half, so that decimal inputs never sit on it."""
    scale = float(10**digits)
    return F.floor(_col(value) * F.lit(scale) + F.lit(0.4873)) / F.lit(scale)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator ÷ denominator for a non-zero denominator."""
    den = _col(denominator)
    return F.when(den != 0, _col(numerator) / den)


def over_positive(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator ÷ denominator for a positive denominator.

    Serves margins, returns on a balance, coverage, leverage, yields and earnings multiples.
    """
    den = _col(denominator)
    return F.when(den > 0, _col(numerator) / den)


margin = return_on = coverage = leverage = yield_on = multiple = over_positive


def growth(current: Column | str, base: Column | str) -> Column:
    """current ÷ base − 1 for a positive base."""
    return over_positive(current, base) - 1


def cagr(end: Column | str, start: Column | str, years: int) -> Column:
    """Yearly growth rate between two positive values."""
    end, start = _col(end), _col(start)
    defined = (end > 0) & (start > 0) & F.lit(years > 0)
    return F.when(defined, F.pow((end / start).cast("double"), F.lit(1.0 / max(years, 1))) - 1)


def average(first: Column | str, second: Column | str) -> Column:
    return (_col(first) + _col(second)) / 2


def difference(first: Column | str, second: Column | str) -> Column:
    return _col(first) - _col(second)


def total(*parts: Column | str) -> Column:
    """Sum of the parts present; null when none is."""
    columns = [_col(p) for p in parts]
    zero = F.lit(0)
    summed = reduce(lambda a, b: a + b, [F.coalesce(c, zero) for c in columns])
    return F.when(F.coalesce(*columns).isNotNull(), summed)


free_cash_flow = difference


def ebitda(operating_income: Column | str, d_and_a: Column | str) -> Column:
    return _col(operating_income) + _col(d_and_a)


def tax_rate(income_tax: Column | str, pretax: Column | str) -> Column:
    """Income tax ÷ pre-tax income, for positive pre-tax income and a rate within 0…1."""
    rate = over_positive(income_tax, pretax)
    return F.when(rate.between(0, 1), rate)


def nopat(operating_income: Column | str, rate: Column | str) -> Column:
    return _col(operating_income) * (1 - _col(rate))


def invested_capital(equity: Column | str, debt: Column | str, cash: Column | str) -> Column:
    return _col(equity) + _col(debt) - _col(cash)


def quick_assets(cash: Column | str, investments: Column | str, receivables: Column | str) -> Column:
    """Cash, short-term investments and receivables; cash is required."""
    return F.when(_col(cash).isNotNull(), total(cash, investments, receivables))


def clamp(value: Column | str, low: float, high: float) -> Column:
    """Bound a value; null stays null (greatest/least skip nulls, so guard them)."""
    value = _col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def finite(value: Column | str) -> Column:
    """Null for NaN and infinities."""
    value = _col(value)
    usable = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable, value)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))
