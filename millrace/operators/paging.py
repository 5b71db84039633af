"""Filters, sorting and pages of listings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Parameters that are numbers, and the bounds and defaults of all kinds of requests (None: no bound).
NUMERIC = (
    "page", "per_page", "limit", "offset", "depth",
    "window_days", "max_depth", "max_results", "min_amount", "max_amount",
    "min_flights", "min_degree", "min_strength", "cluster_id", "claim_a_page_number", "claim_b_page_number",
)
BOUNDS = {
    "page": (1, None, 1),
    "per_page": (1, 100, 20),
    "depth": (1, 4, 2),
    "limit": (1, 200, 50),
    "window_days": (1, 365, 7),
    "max_results": (1, 500, 100),
    "max_depth": (1, 10, 6),
    "min_flights": (1, None, 1),
    "min_degree": (0, None, 1),
}


def coerced(key: Column, value: Column, numeric: tuple[str, ...] = NUMERIC) -> Column:
    """A request's text as a struct of number, flag and text, of which one isn't null: digits of numeric parameters, true and false, all else as it is."""
    number = F.when(key.isin(*numeric) & value.rlike(r"^[0-9]+$"), value.try_cast("long"))
    flag = F.when(number.isNull() & value.isin("true", "false"), value == "true")
    return F.struct(number.alias("number"), flag.alias("flag"), F.when(number.isNull() & flag.isNull(), value).alias("text"))


def bounded(key: Column, value: Column, bounds: dict = BOUNDS) -> Column:
    """A numeric parameter as a struct of value, its default where it is absent, and error, where it is out of its bounds."""
    pick = lambda k: F.coalesce(*[F.when(key == name, F.lit(b[k]).cast("long")) for name, b in bounds.items()])
    held = F.coalesce(value, pick(2))
    error = F.when(held < pick(0), F.concat(F.lit("at least "), pick(0).cast("string"))).when(held > pick(1), F.concat(F.lit("at most "), pick(1).cast("string")))
    return F.struct(held.alias("value"), error.alias("error"))


def coerce(params: dict[str, str], integers: tuple[str, ...] = NUMERIC) -> dict:
    """Texts of a request as values: digits of the named ones as int, true and false as bool, all else as it is."""
    out: dict = {}
    for k, v in params.items():
        out[k] = int(v) if k in integers and re.fullmatch(r"\d+", v) else {"true": True, "false": False}.get(v, v)
    return out


@dataclass(frozen=True)
class Page:
    """Page number and size; sizes beyond the bounds are an error, as they are in the reference's parameters."""

    page: int = 1
    per_page: int = 20

    def __post_init__(self) -> None:
        if not (self.page >= 1 and 1 <= self.per_page <= 100):
            raise ValueError("page >= 1 and per_page in 1..100")


@dataclass(frozen=True)
class Bounds:
    """Ranges of the other parameters."""

    depth: int = 2
    window: int = 7
    max_depth: int = 6
    limits: dict = field(default_factory=lambda: {"depth": (1, 4), "window": (1, 365), "max_depth": (1, 10)})

    def __post_init__(self) -> None:
        for name, (low, high) in self.limits.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} in {low}..{high}")


def optional(df: DataFrame, **equals) -> DataFrame:
    """c = p for each parameter that is given; an absent one adds no filter."""
    for c, p in equals.items():
        if p is not None:
            df = df.where(F.col(c) == F.lit(p))
    return df


def between(df: DataFrame, c: str, low=None, high=None) -> DataFrame:
    """Both ends belong to the range; an absent end is open."""
    if low is not None:
        df = df.where(F.col(c) >= F.lit(low))
    return df if high is None else df.where(F.col(c) <= F.lit(high))


def contains_text(c: Column | str, text: str) -> Column:
    """Case-insensitive substring; % and _ have no special meaning."""
    return F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(text.lower()))


def any_contains(array: Column | str, text: str) -> Column:
    return F.exists(F.col(array) if isinstance(array, str) else array, lambda x: F.contains(F.lower(x), F.lit(text.lower())))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def sort_columns(order: tuple[tuple[str, bool], ...]) -> list[Column]:
    """(column, descending) pairs; nulls come last either way."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def page_of(df: DataFrame, order: tuple[tuple[str, bool], ...], page: Page = Page()) -> DataFrame:
    """One page; order should end in a unique column. Planned as a top-k of page * per_page rows."""
    return df.orderBy(*sort_columns(order)).offset((page.page - 1) * page.per_page).limit(page.per_page)


def envelope(df: DataFrame, page: Page = Page()) -> DataFrame:
    """One row: total, page, per_page, has_more."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.lit(page.page).alias("page"), F.lit(page.per_page).alias("per_page"), (F.lit(page.page * page.per_page) < n).alias("has_more"))


def merge_feeds(feeds: list[DataFrame], by: str, tie: str, limit: int) -> DataFrame:
    """The newest rows of several feeds: each is cut to the limit before they are united."""
    tops = [f.orderBy(F.col(by).desc_nulls_last(), tie).limit(limit) for f in feeds]
    return reduce(DataFrame.unionByName, tops).orderBy(F.col(by).desc_nulls_last(), tie).limit(limit)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by the order; an aggregation with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return ranked.select(*keys, "_r.*")


def seeded(seed: int, id_col: str) -> tuple[Column, Column]:
    """An order that looks random, and is the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), id_col)), F.col(id_col)


def random_row(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """One row by a seeded hash."""
    return df.orderBy(*seeded(seed, id_col)).limit(1)


def numbered(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """df with the rows' numbers from 1 in this order, which should end in a unique column.

    Rows are ranged by the order and numbered within each range; only the ranges' sizes are added up in one place.
    """
    from millrace.operators.graph import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(number, F.col("_start") + own).drop("_range", "_start")
