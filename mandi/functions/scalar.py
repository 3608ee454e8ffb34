"""Column expressions used by several operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km, NULL where a coordinate is; the root is held at 1 or less."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or NULL."""
    return F.when(b != 0, a / b)


def log_return(now: Column, then: Column) -> Column:
    """ln(now / then) of positive prices, else NULL."""
    return F.when((now > 0) & (then > 0), F.ln(now / then))


def median(x) -> Column:
    """Interpolated median; percentile also works over window frames, where median() doesn't."""
    return F.percentile(x, F.lit(0.5))


def price_valid(price: Column) -> Column:
    return F.coalesce(price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < float("inf")), F.lit(False))


def split_of(date: Column, splits: dict[str, tuple[str, str]]) -> Column:
    """Name of the split whose date range holds the date, else NULL."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(splits.items()):
        out = F.when(date.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(name)).otherwise(out)
    return out


def severity(x: Column, bounds: tuple[float, ...] = (0.2, 0.5, 1.0), names: tuple[str, ...] = ("below_20pct", "elevated", "high", "extreme")) -> Column:
    """Left-closed buckets of a return."""
    out = F.when(x < bounds[0], names[0])
    for b, name in zip(bounds[1:], names[1:], strict=False):
        out = out.when(x < b, name)
    return F.when(x.isNotNull(), out.otherwise(names[-1]))


def calendar(date: Column, prefix: str) -> dict[str, Column]:
    """Month and the day of the year on a circle."""
    angle = 2 * F.pi() * F.dayofyear(date) / 365.25
    return {f"{prefix}_month": F.month(date), f"{prefix}_day_sin": F.sin(angle), f"{prefix}_day_cos": F.cos(angle)}


def _compatible(names: pd.Series) -> pd.Series:
    """Unicode's compatibility form: full- and half-width forms, ligatures and composed marks made one."""
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def market_key(name: Column) -> Column:
    """A name for finding candidate matches: its compatibility form in lower case, without spaces and brackets."""
    return F.regexp_replace(F.lower(F.pandas_udf(_compatible, "string")(name)), r"[\s()\[\]{}<>\u3008-\u3011\u3014-\u301b]+", "")


def bin_start(date: Column, anchor: str, days: int) -> Column:
    """First day of the anchored bin that holds the date."""
    first = F.lit(anchor).cast("date")
    return F.date_add(first, (F.floor(F.datediff(date, first) / days) * days).cast("int"))
