"""Schema-driven table explorer: allowed tables, column aliases, filters, pages, counts, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import niin_input
from .filters import any_contains, every, page, safe_ident

# Tables that may be asked, and of them those that need a filter.
TABLES = ("contracts_rolled", "transactions", "summary", "nsn_cage_reference")
GRANULAR = ("contracts_rolled", "transactions", "nsn_cage_reference")
# Columns that may be asked.
COLUMNS = (
    "contract_id", "year", "action_date", "last_action_date", "total_spend", "spend_amount", "contract_count",
    "vendor_cage", "cage_code", "cage", "vendor_name", "sub_agency", "parent_agency", "clean_parent",
    "psc", "psc_code", "psc_description", "naics_code", "naics_description",
    "platform_family", "market_segment", "description",
    "city", "state", "country", "piid", "idv_piid", "transaction_id",
    "nsn", "niin", "part_number", "pricing_type", "set_aside_type", "competition_type", "offers_count",
    "fsc", "fsc_code", "item_name", "nomenclature", "source", "source_layer", "data_source",
    "demil_code", "shelf_life_code", "mgmt_control_code", "unit_of_issue",
    "source_of_supply", "govt_estimated_price", "acquisition_advice_code",
)
# Columns shown where none are asked for.
SHOWN: dict[str, tuple[str, ...]] = {
    "contracts_rolled": ("contract_id", "last_action_date", "vendor_name", "vendor_cage", "total_spend", "description"),
    "transactions": ("contract_id", "action_date", "vendor_name", "vendor_cage", "spend_amount", "nsn", "part_number", "description"),
    "summary": ("vendor_name", "cage_code", "clean_parent", "total_spend", "contract_count", "market_segment", "platform_family"),
    "nsn_cage_reference": ("nsn", "niin", "cage_code", "vendor_name", "part_number", "description", "fsc_code", "source"),
}
# Other names that a column of the reference table may have, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "cage": ("cage", "cage_code", "vendor_cage"),
    "cage_code": ("cage_code", "cage", "vendor_cage"),
    "vendor_cage": ("vendor_cage", "cage_code", "cage"),
    "vendor_name": ("vendor_name", "company_name", "manufacturer_name", "entity_name"),
    "description": ("description", "item_name", "nomenclature", "product_description", "item_description"),
    "item_name": ("item_name", "description", "nomenclature"),
    "fsc_code": ("fsc_code", "fsc"),
    "fsc": ("fsc", "fsc_code"),
    "source": ("source", "source_layer", "data_source"),
}
# Columns that a search reads, and limits.
SEARCHED = ("nsn", "niin", "part_number", "description", "item_name", "nomenclature", "cage", "cage_code", "vendor_cage", "vendor_name")
MOST, PREVIEW, PAGE, EXPORT_FREE, EXPORT_PAID = 500_000, 50, 500, 1000, 5000


def resolve(df: DataFrame, name: str, table: str = "nsn_cage_reference") -> str | None:
    """The column itself, else (in the reference table) the first of its other names that is there."""
    names = set(df.columns)
    if name in names:
        return name
    return next((a for a in ALIASES.get(name, ()) if a in names), None) if table == "nsn_cage_reference" else None


def build(table: str, df: DataFrame, filters: Mapping[str, object] | None = None, q: str | None = None, min_spend: float | None = None, max_spend: float | None = None) -> DataFrame:
    """Filtered rows of an allowed table.  Filters on other columns than the allowed ones, and empty ones, are passed over;
    `q` searches the reference table only; granular tables need a filter that counts."""
    if table not in TABLES:
        raise ValueError(f"not a table to explore: {table}")
    parts: list[Column] = []
    for name, value in (filters or {}).items():
        asked = safe_ident(name).lower()
        column = resolve(df, asked, table) if asked in COLUMNS else None
        if column is None or value in (None, "", []) or not str(value).strip():
            continue
        c = F.upper(F.trim(F.col(column).cast("string")))
        if asked in ("nsn", "niin"):
            parts.append(niin_input(F.col(column)) == niin_input(F.lit(str(value))))
        elif isinstance(value, (list, tuple)):
            parts.append(c.isin(*[str(v).strip().upper() for v in value]))
        else:
            parts.append(c == str(value).strip().upper())
    spend = next((s for s in (("spend_amount", "total_spend") if table == "transactions" else ("total_spend", "spend_amount")) if s in df.columns), None)
    if spend:
        parts += [F.col(spend) >= min_spend] * (min_spend is not None) + [F.col(spend) <= max_spend] * (max_spend is not None)
    if q and table == "nsn_cage_reference":
        columns = dict.fromkeys(filter(None, (resolve(df, c, table) for c in SEARCHED)))
        if columns:
            parts.append(any_contains(q, *columns))
    if not parts and table in GRANULAR:
        raise ValueError(f"{table} needs a filter")
    return df.where(every(parts))


def select(df: DataFrame, columns: Sequence[str] = (), table: str = "nsn_cage_reference") -> DataFrame:
    """Allowed columns that the table has, under the names asked for; the table's usual ones where none are."""
    pairs = [(c, resolve(df, safe_ident(c).lower(), table)) for c in columns if c.lower() in COLUMNS]
    pairs = [(c, r) for c, r in pairs if r] or [(c, r) for c in SHOWN[table] if (r := resolve(df, c, table))]
    return df.select(*[F.col(r).alias(c) for c, r in pairs])


def preview(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return page(df, order, PREVIEW)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def export(df: DataFrame, path: str, order: Sequence[Column], paid: bool = False) -> None:
    """One CSV file with a header; the row cap is the feature."""
    page(df, order, EXPORT_PAID if paid else EXPORT_FREE).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
