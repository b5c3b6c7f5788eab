"""Predicates as columns: the summary filter, contains and equality in folded space, keyset pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that an answer holds at most where nothing else bounds it.
MAX_ROWS = 2000


def safe_int(value, default: int, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


def safe_years(years: Sequence | None, low: int = 1900, high: int = 2200, most: int = 50) -> list[int]:
    """Whole numbers in range, each once, in order of appearance; so many at most that the list can stand in a filter."""
    out = [int(y) for y in years or () if re.fullmatch(r"\d{4}", str(y)) and low <= int(y) <= high]
    return list(dict.fromkeys(out))[:most]


def safe_ident(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def sanitize(text: str | None) -> str:
    return (text or "").replace("'", "").replace(";", "").replace("--", "").strip().upper()


def contains(c: Column, text: str) -> Column:
    """Literal, without regard to case: nothing in `text` is a wildcard."""
    return F.upper(c).contains(text.upper())


def contains_pattern(c: Column, text: str) -> Column:
    """Like `contains`, but % and _ in `text` are wildcards, as users of those fields expect; a backslash is itself."""
    return F.upper(c).like("%" + text.upper().replace("\\", "\\\\") + "%")


def any_contains(text: str, *columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(contains(F.col(c), text), F.lit(False)) for c in columns])


def equals(c: Column, text: str) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit("")))) == text.strip().upper()


def every(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass
class Filters:
    """Parameters that the dashboard queries have in common."""

    years: Sequence[int] = ()
    vendor: str | None = None
    parent: str | None = None
    cage: str | None = None
    domain: str | None = None
    agency: str | None = None
    platform: str | None = None
    psc: str | None = None
    threshold_m: float | str | None = None
    extra: list[Column] = field(default_factory=list)

    def column(self) -> Column:
        """Marts hold upper-cased text, so equality compares plain columns and reaches the Parquet scan."""
        parts = list(self.extra)
        if years := safe_years(self.years):
            parts.append(F.col("year").isin(years))
        try:
            threshold = float(self.threshold_m or 0)
        except ValueError:
            threshold = 0
        if threshold > 1:
            parts.append(F.col("total_spend") >= threshold * 1e6)
        if self.vendor:
            parts.append(contains(F.col("vendor_name"), self.vendor))
        for name, value in (("clean_parent", self.parent), ("cage_code", self.cage), ("market_segment", self.domain), ("sub_agency", self.agency), ("platform_family", self.platform)):
            if value:
                parts.append(F.col(name) == value.strip().upper())
        if self.psc:
            parts.append(contains(F.col("psc_code"), self.psc) | contains(F.col("psc_description"), self.psc))
        return every(parts)

    def specific(self) -> bool:
        return any((self.years, self.vendor, self.parent, self.cage, self.domain, self.agency, self.platform, self.psc))


def exact(years: Sequence, vendor: str | None = None, domain: str | None = None, agency: str | None = None, platform: str | None = None, psc: str | None = None) -> Column:
    """The older filter: years are a must, all else is equality; psc is a code or a description."""
    parts = [F.col("year").isin([int(y) for y in years])]
    for name, value in (("vendor_name", vendor and vendor.upper()), ("market_segment", domain), ("sub_agency", agency), ("platform_family", platform)):
        if value:
            parts.append(F.col(name) == value)
    if psc:
        parts.append((F.col("psc_code") == psc) | (F.col("psc_description") == psc))
    return every(parts)


def since(column: str, as_of: str, days: int) -> Column:
    """Dates kept as ISO text, from `days` before `as_of` on.  The comparison of texts reaches the Parquet scan; the cast drops
    what is no date."""
    first = (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()
    return (F.col(column) >= first) & (F.col(column).try_cast("date") >= F.lit(first).cast("date"))


def is_code(text: str) -> bool:
    """Starts with a digit, or is a letter and three more characters: a code to match by prefix."""
    return text[:1].isdigit() or (len(text) == 4 and text[:1].isalpha())


def domain_match(text: str, codes: Sequence[str] = ("psc", "naics"), fields: Sequence[str] = ("title", "description")) -> Column:
    if is_code(text):
        return reduce(lambda a, b: a | b, [F.col(c).startswith(text.upper()) for c in codes])
    return reduce(lambda a, b: a | b, [contains(F.col(c), text) for c in fields])


def after(keys: Sequence[str], values: Sequence) -> Column:
    """Rows behind `values` in descending order of all keys (none null)."""
    return F.struct(*keys) < F.struct(*[F.lit(v) for v in values])


def subset(df: DataFrame, where: Sequence[Column] = (), columns: Sequence[str] = (), order: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Any scan of a table: filters, columns (others than the table's are an error), `name [ASC|DESC], ...` to sort by, a page.

    All keys of the order count.  Without a limit there are MAX_ROWS rows at most."""
    keys = []
    for part in filter(None, (x.strip() for x in order.split(","))):
        name, _, way = part.partition(" ")
        if safe_ident(name) not in df.columns or way.strip().upper() not in ("", "ASC", "DESC"):
            raise ValueError(f"can't sort by {part!r}")
        keys.append(F.desc(name) if way.strip().upper() == "DESC" else F.asc(name))
    for c in columns:
        if safe_ident(c) not in df.columns:
            raise ValueError(f"no such column: {c!r}")
    rows = df.where(every(where)).orderBy(*keys) if keys else df.where(every(where))
    rows = rows.select(*columns) if columns else rows
    return (rows.offset(offset) if offset else rows).limit(safe_int(limit, MAX_ROWS, 1, 500_000))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    limit, offset = safe_int(limit, 50, 1, 500_000), safe_int(offset, 0, 0, 10_000_000)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
