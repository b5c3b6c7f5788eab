"""The query catalogue: one function a question, over marts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators.filters import Filters, after, any_contains, contains, domain_match, equals, every, page, safe_int, safe_years, sanitize, since
from .marts import merged_trends

_SPEND, _COUNT = "total_spend", "contract_count"


def _spend(c: str = _SPEND, name: str = _SPEND) -> Column:
    return N.total(F.col(c)).alias(name)


def _contracts() -> Column:
    return F.sum(_COUNT).alias("contracts")


# -- dashboard --------------------------------------------------------------------------------------------------------


def kpis(s: DataFrame, f: Filters) -> DataFrame:
    return s.where(f.column()).agg((F.coalesce(_spend(), F.lit(0.0)) / 1e9).alias("total_spend_b"), F.coalesce(_contracts(), F.lit(0)).alias("total_contracts"))


def options(s: DataFrame, column: str, f: Filters | None = None, most: int = 5000) -> DataFrame:
    rows = s.where(f.column()) if f else s
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most)


def psc_pairs(s: DataFrame, f: Filters, most: int = 5000) -> DataFrame:
    return s.where(f.column()).select("psc_code", "psc_description").dropna().distinct().orderBy("psc_code", "psc_description").limit(most)


def top_parents(s: DataFrame, f: Filters, k: int = 50) -> DataFrame:
    return s.where(f.column()).groupBy("clean_parent").agg(_spend()).orderBy(F.desc(_SPEND), "clean_parent").limit(k)


def trend_yearly(s: DataFrame, f: Filters) -> DataFrame:
    return N.filled_years(s.where(f.column()).groupBy("year").agg(_spend(name="amount")))


def trend_monthly(s: DataFrame, f: Filters) -> DataFrame:
    month = F.coalesce("month", F.lit(1)).alias("month")
    return s.where(f.column()).groupBy(month).agg(_spend()).withColumn("place", N.fiscal_order(F.col("month"))).orderBy("place")


def subsidiaries(s: DataFrame, geo: DataFrame, f: Filters, k: int = 200) -> DataFrame:
    top = s.where(f.column()).groupBy("cage_code", "vendor_name").agg(_spend(), _contracts()).orderBy(F.desc(_SPEND), "cage_code", "vendor_name").limit(k)
    where = geo.select("cage_code", "city", "state").dropDuplicates(["cage_code"])
    return top.join(where, "cage_code", "left").select("cage_code", "vendor_name", _SPEND, "contracts", F.coalesce("city", F.lit("N/A")).alias("city"), F.coalesce("state", F.lit("N/A")).alias("state"))


def top_vendors(s: DataFrame, f: Filters, k: int = 50, by: str = "clean_parent") -> DataFrame:
    out = s.where(f.column()).groupBy(by).agg(_spend(), _contracts())
    return out.withColumn("spend_m", F.col(_SPEND) / 1e6).orderBy(F.desc(_SPEND), by).limit(k)


def distribution(s: DataFrame, column: str, f: Filters, most: int = 10, shown: int = 4) -> DataFrame:
    """First groups by spend, and Other: what is left of the grand total, groups without a label included.

    The first groups fit in one row, so one pass over the groups serves the groups, their sum and the total."""
    by = s.where(f.column()).groupBy(F.col(column).alias("label")).agg(_spend(name="value"))
    first = by.orderBy(F.desc("value"), F.asc_nulls_last("label")).limit(most).where("label IS NOT NULL").orderBy(F.desc("value"), "label").limit(shown)
    total = by.agg(F.coalesce(_spend("value", "total"), F.lit(0.0)).alias("total"))
    # one row each
    rows = first.agg(F.collect_list(F.struct("label", "value")).alias("g"), F.coalesce(_spend("value", "used"), F.lit(0.0)).alias("used")).crossJoin(total).where("total > 0")
    left = F.greatest(F.lit(0.0), N.money(F.col("total")) - N.money(F.col("used"))).cast("double")
    every_ = F.concat("g", F.filter(F.array(F.struct(F.lit("Other").alias("label"), left.alias("value"))), lambda x: x["value"] > 0))
    return rows.select(F.inline(every_), "total").select("label", "value", F.round(F.col("value") * 100 / F.col("total"), 1).alias("pct"))


def map_points(s: DataFrame, geo: DataFrame, f: Filters, before: int = 150_000, shown: int = 50_000) -> DataFrame:
    """The top-k stands before the join too: the optimizer does not push it through."""
    top = s.where(f.column()).where(F.col("cage_code").isNotNull()).groupBy(F.upper(F.trim("cage_code")).alias("cage")).agg(F.max("vendor_name").alias("vendor"), _spend()).orderBy(F.desc(_SPEND), "cage").limit(before)
    points = geo.select(F.upper(F.trim("cage_code")).alias("cage"), "latitude", "longitude", "city", "state").dropna(subset=["latitude", "longitude"])
    return top.join(points, "cage").orderBy(F.desc(_SPEND), "cage").limit(shown)


def recompete(risk: DataFrame, as_of: str, days: int = 90, f: Sequence[Column] = ()) -> DataFrame:
    d, now = F.col("completion_date").try_cast("date"), F.lit(as_of).cast("date")
    out = risk.where(every(f)).where(d.between(now, F.date_add(now, days))).agg(F.coalesce(_spend("spend_amount", "value"), F.lit(0.0)).alias("value"), F.countDistinct("contract_id").alias("contracts"))
    return out.withColumn("value_b", F.round(F.col("value") / 1e9, 6))


def open_opportunities(opps: DataFrame, as_of: str, agency: str | None = None, texts: Sequence[str] = (), k: int = 50) -> DataFrame:
    """Open ones by deadline, with how many there are in all; each text stands in title or description."""
    parts = [contains(F.col("agency"), a) for a in (agency,) if a] + [contains(F.col("title"), t) | contains(F.col("description"), t) for t in texts]
    rows = opps.where(every(parts)).where(F.col("deadline").try_cast("date") >= F.lit(as_of).cast("date"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.asc_nulls_last("deadline"), "id").limit(k).crossJoin(total).select("id", "sol_num", "agency", "deadline", "total")


def legacy_distribution(s: DataFrame, column: str, f: Filters | Column, shown: int = 5) -> DataFrame:
    """Shares of the labelled, positive groups only: the first ones, and what is left of their total."""
    by = s.where(f if isinstance(f, Column) else f.column()).groupBy(F.col(column).alias("label")).agg(_spend(name="value")).where("value > 0 AND trim(label) NOT IN ('', '0')")
    first = by.orderBy(F.desc("value"), "label").limit(shown)
    total = by.agg(_spend("value", "total"))
    rows = first.agg(F.collect_list(F.struct("label", "value")).alias("g"), _spend("value", "used")).crossJoin(total)
    left = (N.money(F.col("total")) - N.money(F.col("used"))).cast("double")
    every_ = F.concat("g", F.filter(F.array(F.struct(F.lit("Other").alias("label"), left.alias("value"))), lambda x: x["value"] > 0))
    return rows.select(F.inline(every_), "total").select("label", "value", F.round(F.col("value") * 100 / F.col("total"), 1).alias("pct"))


def legacy_kpis(s: DataFrame, where: Column) -> DataFrame:
    return s.where(where).agg((F.coalesce(_spend(), F.lit(0.0)) / 1e9).alias("total_spend_b"), F.coalesce(_contracts(), F.lit(0)).alias("total_contracts"))


def legacy_trend(s: DataFrame, where: Column, mode: str = "yearly") -> DataFrame:
    """Billions by year, or by month; gaps stay gaps."""
    label = "year" if mode == "yearly" else "month"
    return s.where(where).groupBy(F.col(label).alias("label")).agg((_spend() / 1e9).alias("spend")).orderBy("label")


def legacy_top_vendors(s: DataFrame, where: Column, k: int = 50) -> DataFrame:
    by = s.where(where).groupBy(F.col("vendor_name").alias("vendor")).agg(_spend(), _contracts())
    return by.orderBy(F.desc(_SPEND), "vendor").limit(k).select("vendor", (F.col(_SPEND) / 1e6).alias("spend_m"), "contracts")


def legacy_map(s: DataFrame, geo: DataFrame, f: Filters, least: float = 1e6, k: int = 50_000) -> DataFrame:
    by = s.where(f.column()).groupBy("cage_code", "vendor_name").agg(_spend()).where(F.col(_SPEND) > 0)
    return by.join(geo.select("cage_code", "latitude", "longitude"), "cage_code").where(F.col(_SPEND) > least).orderBy(F.desc(_SPEND), "cage_code").limit(k)


def details(tx: DataFrame, vendor: str, month: str | None = None, k: int = 100) -> DataFrame:
    parts = [equals(F.col("vendor_name"), vendor)] + [F.col("action_date").startswith(m) for m in (month,) if m]
    return page(tx.where(every(parts)).select("contract_id", "action_date", "line_no", "part_number", "spend_amount"), [F.col("action_date"), F.col("contract_id"), F.col("line_no"), F.col("part_number"), F.col("spend_amount")], k)


def vendor_groups(s: DataFrame, k: int = 50) -> DataFrame:
    """The first k vendors by spend, and all others by name."""
    by = s.groupBy("vendor_name").agg(_spend())
    top = by.orderBy(F.desc(_SPEND), "vendor_name").limit(k).select("vendor_name", F.lit("top").alias("part"))
    return top.unionByName(by.join(top, "vendor_name", "left_anti").select("vendor_name", F.lit("rest").alias("part")))


# -- awards -----------------------------------------------------------------------------------------------------------

AWARD_ORDER = ("total_spend", "last_action_date", "contract_id")


def award_search(rolled: DataFrame, q: str | None = None, filters: Sequence[Column] = (), seek: Sequence | None = None, limit: int = 50, as_of: str | None = None, least: float = 1e6) -> DataFrame:
    """Pages by spend, date, id, all descending; one row more than asked tells that there are more.  Without any filter:
    `least` and more, and active within 730 days."""
    parts = list(filters)
    if q:
        parts.append(any_contains(q, "contract_id", "vendor_name", "description", "psc"))
    if not parts:
        parts.append(F.col("total_spend") >= least)
        if as_of:
            parts.append(since("last_action_date", as_of, 730))
    if seek:
        parts.append(after(AWARD_ORDER, seek))
    rows = rolled.where(every(parts)).select(*AWARD_ORDER, "vendor_name", "sub_agency")
    return rows.orderBy(*[F.desc(c) for c in AWARD_ORDER]).limit(limit + 1)


def award_profile(rolled: DataFrame, contract_id: str) -> DataFrame:
    agency = F.when(F.trim(F.coalesce("sub_agency", F.lit(""))) == "", F.col("parent_agency")).otherwise(F.col("sub_agency"))
    return rolled.where(F.col("contract_id") == contract_id).limit(1).withColumn("agency", agency)


def award_history(tx: DataFrame, contract_id: str, k: int = 200) -> DataFrame:
    rows = tx.where(F.col("contract_id") == contract_id).select("contract_id", "action_date", "line_no", "vendor_name", "part_number", "spend_amount")
    return page(rows, [F.col("action_date"), F.col("line_no"), F.col("part_number"), F.col("spend_amount")], k)


def recent_wins(tx: DataFrame, as_of: str, least: float, days: int = 180, k: int = 50) -> DataFrame:
    rows = tx.where(since("action_date", as_of, days) & (F.col("spend_amount") > least))
    return page(rows.select("contract_id", "action_date", "line_no", "vendor_name", "part_number", "spend_amount"), [F.desc("action_date"), F.desc("spend_amount"), F.col("contract_id"), F.col("line_no"), F.col("part_number")], k)


def awards_page(tx: DataFrame, parts: Sequence[Column], limit: int, offset: int = 0, by_date: bool = False) -> DataFrame:
    rows = tx.where(every(parts)).select("contract_id", "action_date", "line_no", "vendor_cage", "part_number", F.coalesce("sub_agency", "parent_agency").alias("agency"), "spend_amount")
    tie = [F.col("contract_id"), F.col("line_no"), F.col("part_number"), F.col("vendor_cage")]
    first = [F.desc("action_date"), F.desc("spend_amount")] if by_date else [F.desc("spend_amount"), F.desc("action_date")]
    return page(rows, [*first, *tie], limit, offset)


# -- platforms --------------------------------------------------------------------------------------------------------


def platform_top(s: DataFrame, f: Filters, k: int = 12) -> DataFrame:
    out = s.where(f.column()).groupBy("platform_family").agg(_spend(), _contracts()).orderBy(F.desc(_SPEND), "platform_family").limit(safe_int(k, 12, 1, 100))
    return out.where("trim(platform_family) <> ''")


def platform_vendors(s: DataFrame, platform: str, k: int = 10, offset: int = 0) -> DataFrame:
    rows = s.where(F.col("platform_family") == platform).groupBy("cage_code", "vendor_name").agg(_spend(), _contracts()).withColumn("role", F.lit("PRIME"))
    return page(rows, [F.desc(_SPEND), F.col("cage_code"), F.col("vendor_name")], k, offset)


def platform_agencies(s: DataFrame, platform: str, k: int = 5) -> DataFrame:
    return s.where(F.col("platform_family") == platform).groupBy("sub_agency").agg(_spend()).orderBy(F.desc(_SPEND), "sub_agency").limit(k)


def platform_totals(s: DataFrame, platform: str) -> DataFrame:
    rows = s.where(F.col("platform_family") == platform)
    return rows.agg(_spend(), _contracts(), F.countDistinct("vendor_name").alias("vendors"), F.mode("sub_agency", True).alias("usual_agency"))


def platform_parts(products: DataFrame, bom: DataFrame, platform: str, years: Sequence[int] = (), least: float = 0, limit: int = 100, offset: int = 0, zero: bool = True, names: DataFrame | None = None) -> DataFrame:
    """Parts of a platform by niin: the first row's attributes in order of amount, sums, merged trend, the top vendor's name.

    `least` counts only without years; `zero`: rows without revenue too."""
    rows = products.drop("platform_family").join(bom.where(F.col("platform_family") == sanitize(platform)).select("niin"), "niin")
    wanted = safe_years(years)
    rows = rows.where("total_revenue > 0") if not zero else rows
    rows = rows.where(F.coalesce("total_revenue", F.lit(0.0)) >= least) if least > 0 and not wanted else rows
    rows = rows.withColumn("amount", N.trend_sum(F.col("annual_revenue_trend"), wanted) if wanted else F.coalesce("total_revenue", F.lit(0.0)))
    order = F.struct(-F.col("amount"), F.col("cage"), F.col("part_number"))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("nsn", "description", "fsc_code", "cage")]
    by = rows.groupBy("niin").agg(*first, _spend("amount", "amount"), F.sum(F.col("total_units_sold").cast("decimal(18,4)")).cast("long").alias("total_units_sold"), F.max("last_sold_date").alias("last_sold_date"))
    top = page(by, [F.desc("amount"), F.col("niin")], limit, offset)
    out = top.join(merged_trends(rows.join(top.select("niin"), "niin", "left_semi"), "niin"), "niin", "left")
    out = out.withColumn("annual_revenue_trend", F.coalesce("annual_revenue_trend", F.lit("")))
    if names is None:
        return out
    return out.join(names.select(F.col("cage_code").alias("cage"), F.col("vendor_name").alias("top_vendor_name")).dropDuplicates(["cage"]), "cage", "left").fillna("", ["top_vendor_name"])


def platform_awards(tx: DataFrame, platform: str, agency: str | None = None, years: Sequence[int] = (), threshold: float = 0.5, limit: int = 50, offset: int = 0) -> DataFrame:
    """Actions of a platform, latest first; `threshold` is in millions, 0 for none."""
    parts = [F.col("platform_family") == sanitize(platform)]
    parts += [(F.col("sub_agency") == sanitize(agency)) | (F.col("parent_agency") == sanitize(agency))] * bool(agency)
    parts += [F.col("year").isin(safe_years(years))] * bool(years) + [F.col("spend_amount") >= threshold * 1e6] * (threshold > 0)
    return awards_page(tx, parts, safe_int(limit, 50, 1, 500), offset, by_date=True)


def bom_count(bom: DataFrame, platform: str) -> DataFrame:
    return bom.where(F.col("platform_family") == platform).agg(F.countDistinct("niin").alias("n"))


def subcontracts(edges: DataFrame, psc_names: DataFrame, platform: str, limit: int = 50, offset: int = 0, psc: str | None = None, prime: str | None = None, sub: str | None = None) -> DataFrame:
    """Flows of a platform by sub and prime.  Descriptions are listed for the page's groups alone."""
    keys = ["sub_name", "sub_cage", "prime_name", "prime_cage"]
    rows = _subcontracts(edges, platform, psc, prime, sub)
    by = rows.groupBy(*keys).agg(F.max("psc").alias("psc"), F.count(F.lit(1)).alias("n"), _spend("subaward_value", "value"), F.max("action_date").alias("last_date"))
    top = page(by, [F.desc("value"), F.col("sub_cage"), F.col("prime_cage"), F.col("sub_name"), F.col("prime_name")], limit, offset)
    key = F.struct(*keys)
    own = rows.join(top.select(*keys), keys, "left_semi").select(key.alias("key"), "description")
    lists = N.top_lists(own, "key", {"descriptions": F.col("description")}, 3)
    named = top.withColumn("key", key).join(lists, "key", "left").join(psc_names, top["psc"] == psc_names["psc_code"], "left")
    label = F.concat(F.coalesce("psc", F.lit("N/A")), F.lit(" - "), F.coalesce("psc_description", F.lit("Unknown")))
    return named.select(*keys, label.alias("psc_label"), "descriptions", "n", "value", "last_date")


def _subcontracts(edges: DataFrame, platform: str, psc: str | None = None, prime: str | None = None, sub: str | None = None) -> DataFrame:
    """`psc` may be a label (`1620 - GEAR`): its code counts."""
    parts = [F.col("platform_family") == platform]
    parts += [F.col("psc") == (psc or "").split(" - ")[0].strip()] * bool(psc)
    parts += [contains(F.col("prime_name"), prime or "")] * bool(prime) + [contains(F.col("sub_name"), sub or "")] * bool(sub)
    return edges.where(every(parts))


def subcontract_lines(edges: DataFrame, platform: str, limit: int = 50, offset: int = 0, psc: str | None = None, prime: str | None = None, sub: str | None = None) -> DataFrame:
    rows = _subcontracts(edges, platform, psc, prime, sub).select("contract_id", "line_no", "prime_cage", "sub_cage", "description", "action_date", "subaward_value")
    return page(rows, [F.desc("subaward_value"), F.col("contract_id"), F.col("line_no"), F.col("sub_cage"), F.col("action_date"), F.col("description")], limit, offset)


def supply_chain(edges: DataFrame, platform: str) -> DataFrame:
    return edges.where(F.col("platform_family") == platform).groupBy("sub_name", "sub_cage", "sub_city", "sub_state", "prime_name").agg(F.count(F.lit(1)).alias("n"), _spend("subaward_value", "value"))


# -- companies --------------------------------------------------------------------------------------------------------


def company_kpis(k: DataFrame, cage: str, years: Sequence[int] = ()) -> DataFrame:
    parts = [F.col("cage_code") == cage.strip().upper()] + [F.col("year").isin(safe_years(years))] * bool(years)
    return k.where(every(parts)).agg(_spend(), _contracts(), F.max("year").alias("last_year"))


def parent_aggregate(s: DataFrame, parent: str, years: Sequence[int] = ()) -> DataFrame:
    parts = [F.col("clean_parent") == parent] + [F.col("year").isin(safe_years(years))] * bool(years)
    return s.where(every(parts)).agg(_spend(), _contracts(), F.max("year").alias("last_year")).where(F.col(_SPEND) > 0)


def parent_top_naics(s: DataFrame, parent: str, k: int = 5) -> DataFrame:
    """By number of rows, not by spend."""
    label = F.concat_ws(" - ", "naics_code", "naics_description").alias("naics")
    return s.where(F.col("clean_parent") == parent).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "naics").limit(k)


def company_network(edges: DataFrame, name: str, cage: str | None = None, side: str = "subs", k: int = 50) -> DataFrame:
    """One hop: by cage when there is one (over two characters, not AGGREGATE), else by parent."""
    drill = bool(cage) and len(cage) > 2 and cage != "AGGREGATE"
    own, other = ("prime", "sub") if side == "subs" else ("sub", "prime")
    rows = edges.where(F.col(f"{own}_cage") == cage if drill else F.col(f"{own}_gold_parent") == name.upper())
    by = rows.groupBy(F.col(f"{other}_name").alias("name"), F.col(f"{other}_cage").alias("cage")).agg(F.min("platform_family").alias("platform"), _spend("subaward_value", "total"), F.count("contract_id").alias("contracts"))
    return by.orderBy(F.desc("total"), "cage", "name").limit(k)


def company_parts(products: DataFrame, cage: str, years: Sequence[int] = (), rollup: bool = False, platform: str | None = None, fsc: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    parts = [F.col("cage") == cage] + [F.col("platform_family") == platform] * bool(platform) + [F.col("fsc_code") == fsc] * bool(fsc)
    wanted = safe_years(years)
    rows = products.where(every(parts)).withColumn("amount", N.trend_sum(F.col("annual_revenue_trend"), wanted) if wanted else F.col("total_revenue"))
    if not rollup:
        return page(rows.select("niin", "cage", "part_number", "description", "amount", "last_sold_date"), [F.desc("amount"), F.col("niin"), F.col("part_number")], limit, offset)
    rows = rows.withColumn("niin_key", N.niin_input(F.col("niin")))
    u, pu = F.sum(F.col("total_units_sold").cast("decimal(18,4)")).cast("double"), F.sum((F.col("avg_unit_price") * F.col("total_units_sold")).cast("decimal(24,4)")).cast("double")
    by = rows.groupBy("niin_key").agg(_spend("amount", "amount"), F.max("last_sold_date").alias("last_sold_date"), F.round(F.when(u > 0, pu / u).otherwise(F.avg("avg_unit_price")), 4).alias("price"), F.countDistinct("part_number").alias("part_count"))
    top = page(by, [F.desc("amount"), F.col("niin_key")], limit, offset)
    own = rows.join(top.select("niin_key"), "niin_key", "left_semi")
    # all part numbers of the page's parts, each once, in order of the rows that name them first
    named = own.where(F.trim("part_number") != "").groupBy("niin_key", "part_number").agg(F.min(F.struct(-F.col("amount"), F.col("part_number"))).alias("o"))
    numbers = named.groupBy("niin_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["part_number"]), ",").alias("part_numbers"))
    out = top.join(numbers, "niin_key", "left").join(merged_trends(own, "niin_key"), "niin_key", "left")
    return out.withColumn("part_numbers", F.coalesce("part_numbers", F.lit("")))


def company_awards(tx: DataFrame, cage: str | None = None, name: str | None = None, years: Sequence[int] = (), agency: str | None = None, least: float = 0, limit: int = 50, offset: int = 0) -> DataFrame:
    """By cage, else by a part of the name; largest first."""
    parts = [F.col("vendor_cage") == sanitize(cage)] if cage else [contains(F.col("vendor_name"), sanitize(name))]
    parts += [F.col("year").isin(safe_years(years))] * bool(years) + [F.col("spend_amount") >= least * 1e6] * (least > 0)
    parts += [contains(F.col("sub_agency"), agency or "") | contains(F.col("parent_agency"), agency or "")] * bool(agency)
    return awards_page(tx, parts, limit, offset)


def company_parts_count(products: DataFrame, cage: str) -> DataFrame:
    return products.where(F.col("cage") == cage).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(N.niin_input(F.col("niin"))).alias("niins"))


def naics_matches(opps: DataFrame, codes: Sequence[str], as_of: str, agency: str | None = None, domain: str | None = None, k: int = 50) -> DataFrame:
    """Open opportunities whose code starts with one of the company's (digits, three or more)."""
    good = [c for c in codes if c.isdigit() and len(c) >= 3]
    hit = F.lit(False)
    for c in good:
        hit = hit | F.col("naics").startswith(c)
    parts = [hit] + [contains(F.col("agency"), a) for a in (agency,) if a] + [domain_match(d) for d in (domain,) if d]
    rows = opps.where(every(parts)).where(F.col("deadline").try_cast("date") >= F.lit(as_of).cast("date"))
    return rows.select("id", "naics", "agency", "deadline").orderBy(F.asc_nulls_last("deadline"), "id").limit(k)


def shares(s: DataFrame, cage: str, column: str, k: int = 3) -> DataFrame:
    """Top groups of a company with whole percentages, at most 100, and how many more there are."""
    by = s.where(F.col("cage_code") == cage).groupBy(F.col(column).alias("label")).agg(_spend(name="value"))
    total = by.agg(_spend("value", "total"), F.count(F.lit(1)).alias("groups"))
    top = by.orderBy(F.desc("value"), "label").limit(k).crossJoin(total)
    return top.select("label", "value", F.least(F.lit(100), F.floor(F.try_divide(F.col("value") * 100, "total"))).cast("int").alias("pct"), F.greatest(F.lit(0), F.col("groups") - k).alias("hidden"))


def naics_titles(profiles: DataFrame, titles: DataFrame) -> DataFrame:
    """Each profile's codes with their title, by code, else by its first 5, else 4 characters."""
    codes = profiles.select("cage_code", F.explode(F.split("top_naics_codes", ", ")).alias("item")).withColumn("code", F.regexp_extract("item", "^([0-9]+)", 1)).where("code <> ''")
    for k, n in enumerate((99, 5, 4)):
        codes = codes.join(titles.select(F.col("code").alias(f"c{k}"), F.col("title").alias(f"t{k}")), F.substring("code", 1, n) == F.col(f"c{k}"), "left")
    return codes.select("cage_code", "code", F.coalesce("t0", "t1", "t2").alias("title"))


# -- parts ------------------------------------------------------------------------------------------------------------


def reference_suppliers(reference: DataFrame, niin: str) -> DataFrame:
    """Suppliers that the catalogue lists for a part: their part numbers and sources, each once."""
    rows = reference.where((F.col("niin") == N.niin_input(F.lit(niin))) & (F.trim("cage") != ""))
    rows = rows.select(F.upper(F.trim("cage")).alias("cage"), F.nullif(F.trim("part_number"), F.lit("")).alias("part_number"), "revenue_status").where(~F.col("cage").isin(*N.CAGE_NULLS))
    lists = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    # one part of one supplier: what is listed is bounded by the catalogue's rows for it
    out = rows.groupBy("cage").agg(lists("part_number").alias("part_numbers"), lists("revenue_status").alias("source"))
    return out.withColumn("part_numbers", F.coalesce(F.nullif("part_numbers", F.lit("")), F.lit("\u2014")))


def nsn_suppliers(lookup: DataFrame, reference: DataFrame, niin: str, names: DataFrame | None = None, where: Sequence[Column] = ()) -> DataFrame:
    """Suppliers by sales; those of the catalogue only where nothing was sold.  Names by `N.vendor_label`."""
    key = N.niin_input(F.lit(niin))
    sold = lookup.where(F.col("niin") == key).where(every(where)).groupBy("cage").agg(F.max("vendor").alias("vendor"), F.countDistinct("contract_id").alias("contracts"), F.max("last_sold").alias("last_sold"), _spend("total_revenue", "revenue"))
    listed = reference_suppliers(reference, niin)
    any_sold = sold.agg(F.count(F.lit(1)).alias("n"))
    approved = listed.crossJoin(any_sold).where("n = 0").drop("n")
    out = sold.join(approved, "cage", "full_outer").select(
        "cage", "vendor", F.coalesce("contracts", F.lit(0).cast("long")).alias("contracts"), "last_sold", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.col("source").isNotNull().alias("approved"), F.coalesce("part_numbers", F.lit("\u2014")).alias("part_numbers"), "source")
    if names is not None:
        known = names.select(F.col("cage_code").alias("cage"), F.col("vendor_name").alias("known")).dropDuplicates(["cage"])
        out = out.join(known, "cage", "left").withColumn("vendor", N.vendor_label(F.col("vendor"), F.col("cage"), F.col("known"))).drop("known")
    return out.orderBy(F.desc("revenue"), F.desc("approved"), "cage")


def supplier_union(lookup: DataFrame, reference: DataFrame, niin: str) -> DataFrame:
    """Sellers, and catalogue suppliers that sold nothing."""
    key = N.niin_input(F.lit(niin))
    sold = lookup.where(F.col("niin") == key).groupBy("cage").agg(_spend("total_revenue", "revenue")).withColumn("source", F.lit("SALES"))
    listed = reference.where(F.col("niin") == key).select("cage").distinct().join(sold, "cage", "left_anti")
    return sold.unionByName(listed.select("cage", F.lit(0.0).alias("revenue"), F.lit("REFERENCE").alias("source")))


def nsn_platforms(n: DataFrame, niin: str, k: int = 10) -> DataFrame:
    """`contracts` adds up cells of contract counts, so a contract counts once for each cell."""
    rows = n.where((F.col("niin") == N.niin_input(F.lit(niin))) & F.col("platform_family").isNotNull())
    return rows.groupBy("platform_family").agg(_spend("spend_amount", "spend"), F.sum("contracts").alias("contracts")).orderBy(F.desc("spend"), "platform_family").limit(k)


def nsn_history(n: DataFrame, niin: str) -> DataFrame:
    return N.filled_years(n.where(F.col("niin") == N.niin_input(F.lit(niin))).groupBy("year").agg(_spend("spend_amount", "amount")))


def nsn_contracts(tx: DataFrame, niin: str, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = tx.where((F.col("niin") == N.niin_input(F.lit(niin))) & F.col("spend_amount").isNotNull())
    rows = rows.select("contract_id", "action_date", "line_no", N.null_words(F.col("vendor_name"), N.TEXT_NULLS).alias("vendor"), N.null_words(F.col("platform_family"), N.CATEGORY_NULLS).alias("platform"), "spend_amount")
    return page(rows, [F.desc("action_date"), F.col("contract_id"), F.col("line_no"), F.desc("spend_amount"), F.col("vendor")], safe_int(limit, 50, 1, 200), offset)


def nsn_top(tx: DataFrame, flis: DataFrame, f: Sequence[Column] = (), k: int = 16) -> DataFrame:
    """Top parts by spend, then their catalogue names: the top-k stands before the join."""
    rows = tx.where(every(f)).where(F.length("nsn") == 13)
    top = rows.groupBy(F.substring("nsn", 5, 9).alias("niin")).agg(_spend("spend_amount", "spend"), F.countDistinct("contract_id").alias("contracts"), F.max("description").alias("description")).orderBy(F.desc("spend"), "niin").limit(safe_int(k, 16, 4, 50))
    names = flis.join(top.select("niin"), "niin", "left_semi").groupBy("niin").agg(F.min("item_name").alias("item_name"))
    return top.join(names, "niin", "left").select("niin", "spend", "contracts", F.coalesce("item_name", F.split_part("description", F.lit("!"), F.lit(2))).alias("name"))


def reference_profile(reference: DataFrame, niin: str) -> DataFrame:
    rows = reference.where(F.col("niin") == N.niin_input(F.lit(niin)))
    text = lambda c: F.max(F.nullif(F.trim(c), F.lit(""))).alias(c)
    return rows.agg(F.count(F.lit(1)).alias("n"), text("nsn"), text("description"), F.countDistinct("cage").alias("suppliers"), F.countDistinct("part_number").alias("parts"))


# -- opportunities, search --------------------------------------------------------------------------------------------


#: What the numbers of one agency's solicitations start with.
DIBBS = ("SPE", "SPM", "SPR")


def pipeline_live(
    opps: DataFrame, as_of: str, agency: str | None = None, source: str | None = None, naics: str | None = None, keyword: str | None = None, set_aside: str | None = None,
    state: str | None = None, platform: str | None = None, domain: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """Open solicitations by deadline, each with how many there are in all.  `kind`: DIBBS or SAM, by the number's start."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = F.coalesce(text("sol_num"), text("id"))
    dibbs = reduce(lambda a, b: a | b, [F.upper(number).startswith(x) for x in DIBBS])
    parts = [number.isNotNull()] + [dibbs] * (kind == "DIBBS") + [~dibbs] * (kind == "SAM")
    if agency:
        a = sanitize(agency)
        logistics = contains(F.col("agency"), "LOGISTICS") | (F.col("source_system") == "DLA")
        parts.append(logistics if "DLA" in a or "LOGISTICS" in a else contains(F.col("agency"), a))
    parts += [F.col("source_system") == sanitize(source)] * bool(source) + [contains(F.col("naics"), sanitize(naics))] * bool(naics)
    parts += [contains(F.col("set_aside_type"), sanitize(set_aside))] * bool(set_aside) + [F.col("state") == sanitize(state)] * bool(state)
    parts += [any_contains(sanitize(keyword), "search_text", "title", "description")] * bool(keyword)
    parts += [any_contains(sanitize(platform), "title", "description")] * bool(platform)
    parts += [domain_match(sanitize(domain))] * bool(domain)
    left = F.datediff(F.substring("deadline", 1, 10).try_cast("date"), F.lit(as_of).cast("date"))
    rows = opps.where(every(parts)).withColumn("days_left", left).where("days_left >= 0")
    total = rows.agg(F.count(F.lit(1)).alias("total_matches"))
    shown = page(rows.select("id", number.alias("sol_num"), "agency", "deadline", "days_left", "source_system"), [F.asc_nulls_last("deadline"), F.col("id")], limit, offset)
    return shown.crossJoin(total)


def pipeline_details(opps: DataFrame, key: str) -> DataFrame:
    """By number or id."""
    return opps.where((F.col("sol_num") == key) | (F.col("id") == key)).orderBy("id").limit(1)


def solicitation(opps: DataFrame, number: str) -> DataFrame:
    n = number.strip().upper()
    return opps.where(F.upper("sol_num").isin(n, n.replace("-", "")) | (F.col("id") == number)).orderBy("id").limit(1)


def search_global(index: DataFrame, q: str, k: int = 8) -> DataFrame:
    """All hits merged by entity, the k of most score: sums, and the best row's attributes with a line that describes them.

    What looks like a stock number gives a part as the first hit (place 0).  Nothing in `q` is a wildcard."""
    text = sanitize(q)
    hit = any_contains(text, "label", "value") | F.coalesce(F.upper("cage").startswith(text), F.lit(False))
    rows = index.where(hit)
    cage, folded = F.nullif("cage", F.lit("AGGREGATE")), lambda c: F.upper(F.trim(c))
    key = (
        F.when(F.upper("type").isin("CHILD", "VENDOR") & (cage != ""), F.concat(F.lit("site-"), folded("cage")))
        .when(F.col("type") == "PARENT", F.concat(F.lit("parent-"), folded("label")))
        .otherwise(F.concat(F.upper("type"), F.lit("-"), folded(F.coalesce(F.nullif("value", F.lit("")), "label"))))
    )
    best = F.struct(-F.col("score"), F.col("type"), F.col("value"), F.col("label"))
    top = rows.groupBy(key.alias("key")).agg(F.min_by(F.struct("type", "label", "value", "cage", "city", "state"), best).alias("b"), F.sum(N.money(F.col("score"))).cast("double").alias("score"))
    top = top.orderBy(F.desc("score"), "key").limit(k).select("key", "b.*", "score")
    spend = N.short_money(F.col("score"))
    where = F.when((F.col("city") != "") & (F.col("state") != ""), F.concat_ws(", ", "city", "state")).otherwise(F.coalesce("city", F.lit("")))
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " \u2022 ")
    line = (
        F.when(F.col("type") == "OPPORTUNITY", F.concat(F.lit("Bid \u2022 "), F.coalesce("city", F.lit(""))))
        .when((F.col("type") == "CHILD") & (cage != ""), joined(where, F.concat(F.lit("CAGE: "), "cage"), spend))
        .when(F.col("type") == "PARENT", joined(F.lit("Corporate Rollup"), spend))
        .otherwise(spend)
    )
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "key"))  # over k rows
    out = top.select(place.alias("place"), "key", "type", "label", "value", line.alias("sub_label"), "cage", "score")
    if not re.match(N.PART_SHAPE, q.strip()):
        return out
    part = [(0, f"NSN-{q.strip()}", "NSN", f"Lookup Part: {q.strip()}", q.strip(), "Supply Chain Search", None, None)]
    return index.sparkSession.createDataFrame(part, out.schema.simpleString()).unionByName(out)


def vendor_typeahead(s: DataFrame, q: str, k: int = 10) -> DataFrame:
    rows = s.where(contains(F.col("vendor_name"), q) | contains(F.col("cage_code"), q))
    return rows.groupBy("cage_code").agg(F.max("vendor_name").alias("vendor_name"), F.max("city").alias("city")).orderBy("cage_code").limit(k)


def taxonomy_typeahead(s: DataFrame, kind: str, q: str, k: int = 15) -> DataFrame:
    code, name = ("naics_code", "naics_description") if kind == "naics" else ("psc_code", "psc_description")
    rows = s.where(contains(F.col(code), q) | contains(F.col(name), q))
    return rows.groupBy(F.col(code).alias("code")).agg(F.max(name).alias("name")).orderBy("code").limit(k)


# Words that are no topic of a headline.
GENERIC = (
    "US", "USA", "U.S.", "UK", "U.K.", "PENTAGON", "DOD", "DEFENSE", "MILITARY",
    "ARMY", "NAVY", "AIR", "FORCE", "GOVERNMENT", "CONGRESS", "HOUSE", "SENATE",
    "LOCKHEED", "MARTIN", "BOEING", "NORTHROP", "GRUMMAN", "RTX", "RAYTHEON",
    "COMPANY", "CORP", "INC", "CEO", "CHIEF", "REPORT", "NEWS", "UPDATE", "TODAY",
    "DEAL", "CONTRACT", "AWARD", "WINS", "AGREEMENT", "SALES", "QUARTER", "PROFIT",
    "SAYS", "NEW", "BIG", "VISITS", "AT", "FOR", "TO", "OF", "IN", "ON", "WITH",
)
# Fixed value: a capitalised word, or one in capitals.
TOPIC = r"\b[A-Z][a-z]+\b|\b[A-Z]+\b"


def topic_dedup(titles: DataFrame, generic: Sequence[str] = GENERIC, most: int = 6) -> DataFrame:
    """(feed, pos, title) -> the first `most` titles of each feed that share no topic with one kept before.

    A feed is a page of search results.  Each round takes the next title of every feed that is not done, so a long feed is
    never gathered: `most` rounds, each a join of the feeds' open titles with the topics kept last."""
    words = F.regexp_extract_all("title", F.lit(f"({TOPIC})"), F.lit(1))
    topics = F.array_distinct(F.filter(F.transform(words, F.upper), lambda w: (F.length(w) > 2) & ~w.isin(*generic)))
    left, kept = titles.select("feed", F.col("pos").cast("long").alias("pos"), "title", topics.alias("topics")), []
    for _ in range(most):
        taken = left.groupBy("feed").agg(F.min(F.struct("pos", "title", "topics")).alias("t")).select("feed", "t.*")
        kept.append(taken.select("feed", "pos", "title"))
        last = taken.select("feed", F.col("pos").alias("p"), F.col("topics").alias("seen"))
        left = left.join(last, "feed").where((F.col("pos") > F.col("p")) & ~F.arrays_overlap("seen", "topics")).drop("p", "seen")
    return reduce(DataFrame.unionByName, kept)
