"""More registered queries: dossiers, filters of the pipeline and the search, older dashboards, cleaning, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import (
    _MONEY_LABEL, AGENCY, BOM, CAGE, EDGES, FLIS, GEO, KPIS, LISTED, LOOKUP, NIIN, OPPS, PARENT, PART_LOOKUP, PLATFORM, PLATFORM_PARTS, PROFILES, ROLLED, ROWS, SUM_TREND, TX, YEAR_LIST, YEARS, S, Tables,
    _live, _own_parts, big, money, w,
)
from .functions import normalize as N
from .operators.filters import contains_pattern, exact, subset
from .plans import dossiers as D
from .plans import queries as Q
from .plans.adapter import AS_OF
from .sources import io
from .streaming import incremental

NAME = "Supplier#000000003"
LEAST, EXPOSURE = 50_000, 4e6

# -- SQL of company profiles ----------------------------------------------------------------------------------------

TITLES = "titles AS (SELECT DISTINCT substr(lpad(CAST(p_size AS VARCHAR), 6, '0'), 1, 5) AS code FROM part)"
_LABELS = "[regexp_extract(x, '^[0-9]+') || ' - title ' || substr(regexp_extract(x, '^[0-9]+'), 1, 5) for x in string_split(top_naics_codes, ', ')]"


def _child(where: str, years: str = "true") -> str:
    return f"""SELECT 'CHILD' AS type, p.vendor_name AS name, p.cage_code AS cage, k.s AS total_obligations, k.c AS total_contracts, k.y AS last_active, string_split(top_platforms, ', ') AS top_platforms, profile_source,
 network_flow_total, network_contract_count, network_last_active_year, geo.city AS city, geo.state AS state, {_LABELS} AS top_naics
 FROM profiles p JOIN (SELECT cage_code, {money('total_spend')} AS s, {big('SUM(contract_count)')} AS c, max(year) AS y FROM k WHERE {years} GROUP BY 1) k ON k.cage_code = p.cage_code JOIN geo ON geo.cage_code = p.cage_code WHERE p.{where}"""


CHILD_VIEWS = (TX, S, KPIS, ROLLED, EDGES, PROFILES, GEO)
PARENT_SQL = f"""SELECT 'PARENT' AS type, '{PARENT}' AS name, 'AGGREGATE' AS cage, {money('total_spend')} AS total_obligations, {big('SUM(contract_count)')} AS total_contracts, max(year) AS last_active,
 (SELECT list(platform_family ORDER BY x DESC, platform_family) FROM (SELECT platform_family, {money('total_spend')} AS x FROM s WHERE clean_parent = '{PARENT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_platforms,
 'AWARD_BACKED' AS profile_source, 0.0::DOUBLE AS network_flow_total, 0 AS network_contract_count, 0 AS network_last_active_year, '' AS city, '' AS state,
 (SELECT list(naics ORDER BY n DESC, naics) FROM (SELECT naics_code || ' - ' || naics_description AS naics, count(*) AS n FROM s WHERE clean_parent = '{PARENT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_naics FROM s WHERE clean_parent = '{PARENT}'"""
CODES = f"codes AS (SELECT DISTINCT regexp_extract(unnest(string_split(top_naics_codes, ', ')), '^[0-9]+') AS code FROM profiles WHERE cage_code = '{CAGE}')"
_OFFER = "SELECT id, sol_num, agency, deadline, set_aside_type, naics FROM opps WHERE EXISTS (SELECT 1 FROM codes WHERE starts_with(naics, code))"

# -- SQL of briefs --------------------------------------------------------------------------------------------------


def _title(x: str) -> str:
    """A capital after each character that is no letter."""
    letters = f"string_split(lower({x}), '')"
    return f"array_to_string([CASE WHEN i = 1 OR NOT regexp_matches({letters}[i - 1], '[a-z]') THEN upper({letters}[i]) ELSE {letters}[i] END for i in range(1, length({x}) + 1)], '')"


def _network(own: str, other: str, where: str, k: int) -> str:
    return f"SELECT {other}_name AS name, {other}_cage AS cage, {money('subaward_value')} AS total FROM edges WHERE {own}_{where} GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT {k}"


def _groups(column: str, where: str, k: int) -> str:
    return f"SELECT {column} AS label, {money('total_spend')} AS spend FROM s WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"


def _brief(where: str, side: str, parts: str, tx_where: str) -> str:
    def mix(kind: str, column: str, k: int) -> str:
        label = "label" if kind == "platform" else _title("label")
        return f"SELECT '{kind}', CAST(row_number() OVER (ORDER BY spend DESC, label) AS INTEGER), {label}, spend, CAST(least(100, round_even(spend / total * 100, 0)) AS INTEGER), printf('$%.1fM', spend / 1e6) FROM ({_groups(column, where, k)}), mapped"

    pct = "CAST(CAST(round_even({} / total * 100, 0) AS INTEGER) AS VARCHAR) || '% of federal exposure.'"
    return w(f"""SELECT section, place, label, spend, share, note FROM ({mix('platform', 'platform_family', 10).replace("SELECT 'platform', CAST(", "SELECT 'platform' AS section, CAST(", 1).replace("AS INTEGER), label, spend, CAST(", "AS INTEGER) AS place, label AS label, spend AS spend, CAST(", 1).replace("AS INTEGER), printf('$%.1fM', spend / 1e6)", "AS INTEGER) AS share, printf('$%.1fM', spend / 1e6) AS note", 1)}
 UNION ALL {mix('agency', 'sub_agency', 5)} UNION ALL {mix('capability', 'naics_description', 3)}
 {parts}
 UNION ALL SELECT 'contract', CAST(row_number() OVER (ORDER BY spend_amount DESC, action_date DESC, contract_id, line_no) AS INTEGER), description, spend_amount, NULL, action_date || ' | ' || {_title('sub_agency')} FROM (SELECT * FROM tx WHERE {tx_where} AND spend_amount >= {LEAST} ORDER BY spend_amount DESC, action_date DESC, contract_id, line_no LIMIT 10)
 UNION ALL SELECT 'network', CAST(row_number() OVER (ORDER BY n.total DESC, cage, name) AS INTEGER), name, n.total, NULL, side FROM (SELECT *, 'Top Subcontractors' AS side FROM subs UNION ALL SELECT *, 'Top Prime Customers' FROM primes) n, mapped WHERE side = CASE WHEN prime >= sub AND (SELECT count(*) FROM subs) > 0 THEN 'Top Subcontractors' ELSE 'Top Prime Customers' END
 UNION ALL SELECT 'summary', 1, CASE WHEN a[1].spend / total >= 0.5 THEN 'Highly concentrated: ' || {_title('a[1].label')} || ' stands for ' || {pct.format('a[1].spend')} ELSE 'The first two customers stand for ' || {pct.format('(a[1].spend + a[2].spend)')} END, total, CAST(round_even(prime / total * 100, 0) AS INTEGER), 'share: prime work'
 FROM mapped, (SELECT list(struct_pack(label := label, spend := spend) ORDER BY spend DESC, label) AS a FROM ({_groups('sub_agency', where, 5)})))""",
        TX, S, ROLLED, EDGES, ROWS, f"primes AS ({_network('sub', 'prime', side, 10)})", f"subs AS ({_network('prime', 'sub', side, 10)})",
        f"mapped AS (SELECT sub, {EXPOSURE}::DOUBLE AS prime, sub + {EXPOSURE}::DOUBLE AS total FROM (SELECT coalesce({money('total')}, 0.0::DOUBLE) AS sub FROM primes))")


_PARTS = f"""UNION ALL SELECT 'part', CAST(row_number() OVER (ORDER BY spend DESC, niin) AS INTEGER), niin, spend, NULL, {_title('description')} || ' | ' || platform_family FROM
 (SELECT p.niin, max(description) AS description, max(platform_family) AS platform_family, {money('total_revenue')} AS spend FROM products p JOIN plats ON plats.niin = p.niin WHERE cage = '{CAGE}' AND total_revenue > 0 GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10)"""
_PLATS = f"plats AS (SELECT niin, arg_max(platform_family, sp) AS platform_family FROM (SELECT niin, platform_family, {money('spend_amount')} AS sp FROM tx GROUP BY ALL) GROUP BY 1)"
BRIEF_SQL = _brief(f"cage_code = '{CAGE}'", f"cage = '{CAGE}'", _PARTS, f"vendor_cage = '{CAGE}'").replace("primes AS (", f"{_PLATS}, primes AS (", 1)
PARENT_BRIEF_SQL = _brief(f"clean_parent = '{PARENT}'", f"gold_parent = '{PARENT}'", "", f"vendor_name LIKE '%{PARENT}%'")


def _teaser() -> str:
    def shares(kind: str, rows: str, label: str, share: str, order: str, note: str) -> str:
        return f"SELECT '{kind}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place, {label} AS label, NULL::DOUBLE AS spend, {share} AS share, {note} AS note FROM {rows} LIMIT 3"

    more = "CAST(greatest(0, count(*) OVER () - 3) AS VARCHAR) || ' more'"
    pct = "CAST(round_even({} * 100 / {}, 0) AS INTEGER)"
    plat, cap = _groups("platform_family", f"cage_code = '{CAGE}'", 50), _groups("psc_description", f"cage_code = '{CAGE}'", 15)
    parts = f"SELECT nsn, min(description) AS d, {money('spend_amount')} AS spend FROM tx WHERE vendor_cage = '{CAGE}' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15"
    kind = "CASE WHEN prime >= sub AND n_subs > 0 THEN 'Key Supply Chain Partners' WHEN n_primes > 0 THEN 'Key Customers' WHEN n_subs > 0 THEN 'Key Supply Chain Partners' ELSE 'Network Partners' END"
    chosen = "(SELECT n.* FROM (SELECT *, 'Key Supply Chain Partners' AS side FROM subs UNION ALL SELECT *, 'Key Customers' FROM primes) n, facts WHERE side = kind)"
    says = f"""CASE WHEN prime / total >= 0.9 THEN 'Works almost only as a prime contractor.' WHEN sub / total >= 0.9 THEN 'Works almost only as a supplier of others.' ELSE 'Works both ways, mostly as a ' || CASE WHEN prime >= sub THEN 'prime contractor' ELSE 'supplier of others' END || '.' END
 || CASE WHEN plat.share >= 50 THEN ' Depends on ' || plat.label || ' (about ' || plat.share || '%).' ELSE ' Spread over platforms, led by ' || plat.label || '.' END
 || CASE WHEN partner.share >= 40 AND prime < sub THEN ' Its customers are concentrated: ' || {_title('partner.label')} || ' (about ' || partner.share || '%).' WHEN partner.share >= 40 AND sub / total > 0.15 THEN ' Its work rests on ' || {_title('partner.label')} || ' (about ' || partner.share || '%).' ELSE '' END"""
    return w(f"""SELECT * FROM partners WHERE share > 0 UNION ALL SELECT * FROM platforms WHERE share > 0
 UNION ALL (SELECT 'capability', CAST(row_number() OVER (ORDER BY spend DESC, label) AS INTEGER), {_title('label')}, NULL, NULL, {more} FROM ({cap}) LIMIT 3)
 UNION ALL (SELECT 'part', CAST(row_number() OVER (ORDER BY spend DESC, nsn) AS INTEGER), nsn, NULL, NULL, {_title('d')} || ' | ' || {more} FROM ({parts}) LIMIT 3)
 UNION ALL SELECT 'contract', 1, description, NULL, NULL, NULL FROM (SELECT * FROM tx WHERE vendor_cage = '{CAGE}' ORDER BY spend_amount DESC, contract_id, line_no LIMIT 1)
 UNION ALL SELECT 'summary', 1, {says}, total, CAST(round_even(prime * 100 / total, 0) AS INTEGER), kind FROM facts, (SELECT max(label) AS label, max(share) AS share FROM platforms WHERE place = 1) plat, (SELECT max(label) AS label, max(share) AS share FROM partners WHERE place = 1) partner""",
        TX, S, KPIS, ROLLED, EDGES, f"primes AS ({_network('sub', 'prime', f'''cage = '{CAGE}' ''', 100)})", f"subs AS ({_network('prime', 'sub', f'''cage = '{CAGE}' ''', 100)})",
        f"facts AS (SELECT *, prime + sub AS total, {kind} AS kind FROM (SELECT {money('total_spend')} AS prime FROM s WHERE cage_code = '{CAGE}'), (SELECT coalesce({money('total')}, 0.0::DOUBLE) AS sub, count(*) AS n_primes FROM primes), (SELECT count(*) AS n_subs FROM subs))",
        f"partners AS ({shares('partner', chosen, 'name', pct.format('total', '(' + money('total') + ' OVER ())').replace('AS DOUBLE) OVER ()', 'AS DOUBLE)').replace('SUM(CAST(total AS DECIMAL(18,4)))', 'SUM(CAST(total AS DECIMAL(18,4))) OVER ()'), 'total DESC, cage, name', more)})",
        f"platforms AS ({shares('platform', '(' + plat + ')', 'label', pct.format('spend', 'CAST(SUM(CAST(spend AS DECIMAL(18,4))) OVER () AS DOUBLE)'), 'spend DESC, label', more)})")


# -- registered queries -----------------------------------------------------------------------------------------------


def _profile(t: Tables, **how) -> DataFrame:
    return D.company_profile(t.profiles, t.s, t.geo, t.kpis, t.titles, **how)


def _words(t: Tables) -> DataFrame:
    """Supplier names with legal forms, entities and NAN entries put into them."""
    k = F.col("s_suppkey")
    end = F.when(k % 5 == 0, ", INC.").when(k % 5 == 1, " Corp").when(k % 5 == 2, " CORP. COMPANY").when(k % 5 == 3, "&amp;SONS&lt;x&gt;").otherwise(" LLC,")
    places = F.concat_ws(",", F.when(k % 2 == 0, "NAN"), "s_name", F.when(k % 3 == 0, "NAN"))
    return t.raw("supplier").select(k, F.concat("s_name", end).alias("name"), places.alias("places"), (F.col("s_acctbal") / 10).alias("x"))


def _cleaned(t: Tables) -> DataFrame:
    c, odd = F.col, F.col("s_suppkey") % 4
    known = F.when(c("s_suppkey") % 8 == 3, c("places"))
    return _words(t).select(
        "s_suppkey", N.company(c("name")).alias("company"), N.without_nan_words(c("places")).alias("places"), N.unescaped(c("name")).alias("plain"), N.half_even(F.floor(c("x")) / 2).alias("half"),
        N.code_of(F.concat(c("s_suppkey"), F.lit(" - "), c("name"))).alias("code"), N.optional(F.when(odd == 0, " nat ").otherwise(c("name"))).alias("optional"),
        N.vendor_label(F.when(odd == 0, c("name")).when(odd == 1, "none"), F.when(odd == 2, "96906").otherwise("00042"), known).alias("label"),
        N.title_case(c("name")).alias("title"), N.after_bang(F.concat(F.lit("A!"), c("name"))).alias("after"), c("name").rlike(N.PART_SHAPE).alias("part"), F.lit("1620-01-234-5678").rlike(N.PART_SHAPE).alias("shape"))


CLEANED = f"""SELECT s_suppkey, company, trim(places, ',') AS places, replace(replace(replace(name, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS plain, CAST(round_even(floor(x) / 2, 0) AS INTEGER) AS half, CAST(s_suppkey AS VARCHAR) AS code,
 CASE WHEN s_suppkey % 4 <> 0 THEN name END AS optional, CASE WHEN s_suppkey % 4 = 0 THEN name WHEN s_suppkey % 4 = 2 THEN 'MILITARY STANDARDS (MS)' WHEN s_suppkey % 8 = 3 THEN raw_places ELSE 'Unknown Manufacturer (CAGE: 00042)' END AS label,
 {_title('name')} AS title, name AS after, false AS part, true AS shape FROM (
 SELECT s_suppkey, s_name || ['&amp;SONS&lt;x&gt;', ' LLC,', ', INC.', ' Corp', ' CORP. COMPANY'][1 + (s_suppkey + 2) % 5] AS name, upper(s_name) || ['&AMP;SONS&LT;X&GT;', ' LLC', '', '', ' CORP.'][1 + (s_suppkey + 2) % 5] AS first, s_acctbal / 10 AS x,
 CASE WHEN s_suppkey % 5 = 0 THEN upper(s_name) WHEN s_suppkey % 5 = 1 THEN upper(s_name) WHEN s_suppkey % 5 = 2 THEN upper(s_name) WHEN s_suppkey % 5 = 3 THEN upper(s_name) || '&AMP;SONS&LT;X&GT;' ELSE upper(s_name) || ' LLC' END AS company,
 s_name AS places, concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN 'NAN' END, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'NAN' END) AS raw_places FROM supplier)"""

OLD = "year IN (1998, 1999) AND sub_agency = '" + AGENCY + "'"


def entries() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    old = lambda: exact(YEARS, agency=AGENCY)
    award = "contract_id, action_date, line_no, vendor_cage, part_number, coalesce(sub_agency, parent_agency) AS agency, spend_amount"
    live = lambda where, page: w(_live(where, page), OPPS)
    return {
        # companies
        "company_profile_cage": (lambda t: _profile(t, cage=CAGE.lower()), w(_child(f"cage_code = '{CAGE}'"), *CHILD_VIEWS)),
        "company_profile_years": (lambda t: _profile(t, cage=CAGE, years=YEARS), w(_child(f"cage_code = '{CAGE}'", f"year IN {YEAR_LIST}"), *CHILD_VIEWS)),
        "company_profile_parent": (lambda t: _profile(t, cage="none such", name=PARENT.lower()).withColumn("name", F.upper("name")), w(PARENT_SQL, TX, S)),
        "company_profile_name": (lambda t: _profile(t, name=NAME), w(_child(f"vendor_name = '{NAME.upper()}'"), *CHILD_VIEWS)),
        "company_opportunities": (lambda t: D.company_opportunities(t.profiles, t.opps, AS_OF, cage=CAGE), w(f"{_OFFER} ORDER BY deadline, id LIMIT 50", TX, S, ROLLED, EDGES, PROFILES, CODES, OPPS)),
        "company_opportunities_filtered": (lambda t: D.company_opportunities(t.profiles, t.opps, AS_OF, cage=CAGE, agency=AGENCY[:5].lower(), domain="0000"), w(f"{_OFFER} AND agency LIKE '%{AGENCY[:5]}%' AND (psc LIKE '0000%' OR naics LIKE '0000%') ORDER BY deadline, id LIMIT 50", TX, S, ROLLED, EDGES, PROFILES, CODES, OPPS)),
        "company_opportunities_recommended": (lambda t: D.recommended_opportunities(_profile(t, cage=CAGE), t.opps, AS_OF, agency=AGENCY), w(f"{_OFFER} AND agency = '{AGENCY}' ORDER BY deadline, id LIMIT 50", TX, S, ROLLED, EDGES, PROFILES, CODES, OPPS)),
        "company_awards_name": (lambda t: Q.company_awards(t.tx, name=NAME[:16], years=YEARS, least=0.05, limit=30), w(f"SELECT {award} FROM tx WHERE vendor_name LIKE '%{NAME[:16].upper()}%' AND year IN {YEAR_LIST} AND spend_amount >= 50000 ORDER BY spend_amount DESC, action_date DESC, contract_id, line_no, part_number, vendor_cage LIMIT 30", TX)),
        "unlock_brief": (lambda t: D.unlock_brief(t.s, t.products, t.tx, t.edges, NAME, CAGE, EXPOSURE, LEAST), BRIEF_SQL),
        "unlock_brief_parent": (lambda t: D.unlock_brief(t.s, t.products, t.tx, t.edges, PARENT, None, EXPOSURE, LEAST), PARENT_BRIEF_SQL),
        "company_teaser": (lambda t: D.teaser(_profile(t, cage=CAGE), t.s, t.tx, t.edges, NAME, CAGE), _teaser()),
        # parts and platforms
        "part_profile": (lambda t: D.part_profile(t.lookup, t.products, t.reference, NIIN).withColumn("market_price", F.round("market_price", 4)), w(f"SELECT * REPLACE (CAST(total_units_sold AS BIGINT) AS total_units_sold), total_revenue > 0 AS has_sales_history, 0 AS reference_supplier_count, 0 AS reference_part_count, 0 AS reference_rows, false AS has_reference_history FROM part_lookup WHERE niin = '{NIIN}'", TX, ROWS, FLIS, PART_LOOKUP)),
        "part_profile_years": (lambda t: D.part_profile(t.lookup, t.products, t.reference, "1000-00-000-0007", YEARS).select("niin", F.round("total_revenue", 2).alias("total_revenue"), "has_sales_history"), w(f"SELECT niin, round({SUM_TREND}, 2) AS total_revenue, {SUM_TREND} > 0 AS has_sales_history FROM part_lookup WHERE niin = '{NIIN}'", TX, ROWS, FLIS, PART_LOOKUP)),
        "nsn_reference_suppliers": (lambda t: Q.reference_suppliers(t.reference, NIIN), w(f"SELECT cage, string_agg(DISTINCT part_number, ', ' ORDER BY part_number) AS part_numbers, string_agg(DISTINCT CASE WHEN total_revenue > 0 THEN 'REVENUE_LINKED' ELSE 'REFERENCE_ONLY' END, ', ') AS source FROM listing WHERE niin = '{NIIN}' GROUP BY 1", TX, ROWS, LISTED)),
        "nsn_suppliers_filtered": (lambda t: Q.nsn_suppliers(t.sellers, t.reference, NIIN, t.geo, [F.col("year").isin(YEARS), F.col("sub_agency") == AGENCY]).select("cage", "vendor", "contracts", "revenue"), w(f"""SELECT * FROM own UNION ALL
 SELECT DISTINCT cage, coalesce(vendor_name, 'Unknown Manufacturer (CAGE: ' || cage || ')'), 0, 0.0::DOUBLE FROM listing LEFT JOIN geo ON cage_code = cage WHERE niin = '{NIIN}' AND NOT EXISTS (SELECT 1 FROM own)""", TX, ROWS, LISTED, LOOKUP, GEO, f"own AS (SELECT cage, max(vendor) AS vendor, COUNT(DISTINCT contract_id) AS contracts, {money('total_revenue')} AS revenue FROM lookup WHERE niin = '{NIIN}' AND year IN {YEAR_LIST} AND sub_agency = '{AGENCY}' GROUP BY 1)")),
        "platform_parts_years": (lambda t: Q.platform_parts(t.products, t.bom, PLATFORM, YEARS, limit=50), w(PLATFORM_PARTS, TX, ROWS, BOM, _own_parts(f"coalesce({SUM_TREND}, 0)", "total_revenue > 0"))),
        "platform_parts_least": (lambda t: Q.platform_parts(t.products, t.bom, PLATFORM.lower(), least=60000, limit=50, names=t.geo).select("niin", "amount", "cage", "top_vendor_name"), w(f"SELECT niin, amount, cage, vendor_name AS top_vendor_name FROM ({PLATFORM_PARTS}) x JOIN geo ON geo.cage_code = x.cage", TX, ROWS, BOM, GEO, _own_parts("total_revenue", "total_revenue >= 60000"))),
        "platform_awards_threshold": (lambda t: Q.platform_awards(t.tx, PLATFORM, AGENCY, YEARS, 0.03), w(f"SELECT {award} FROM tx WHERE platform_family = '{PLATFORM}' AND (sub_agency = '{AGENCY}' OR parent_agency = '{AGENCY}') AND year IN {YEAR_LIST} AND spend_amount >= 30000 ORDER BY action_date DESC, spend_amount DESC, contract_id, line_no, part_number, vendor_cage LIMIT 50", TX)),
        "subcontracts_by_psc": (lambda t: Q.subcontract_lines(t.edges, PLATFORM, psc="0011 - X", prime="supplier").select("contract_id", "line_no", "subaward_value"), w(f"SELECT contract_id, line_no, subaward_value FROM edges WHERE platform_family = '{PLATFORM}' AND psc = '0011' ORDER BY subaward_value DESC, contract_id, line_no, sub_cage, action_date, description LIMIT 50", TX, ROLLED, EDGES)),
        # pipeline and search
        "pipeline_live_kind": (lambda t: Q.pipeline_live(t.opps, AS_OF, kind="SAM", set_aside="urgent", keyword="the"), live("sol_num NOT LIKE 'SPE%' AND sol_num NOT LIKE 'SPM%' AND sol_num NOT LIKE 'SPR%' AND upper(set_aside_type) LIKE '%URGENT%' AND (upper(title) LIKE '%THE%' OR upper(description) LIKE '%THE%' OR agency LIKE '%THE%')", "LIMIT 50")),
        "pipeline_live_dibbs": (lambda t: Q.pipeline_live(t.opps, AS_OF, kind="DIBBS", state="st_4", limit=10, offset=1), live("sol_num LIKE 'SPE%' AND state = 'ST_4'", "LIMIT 10 OFFSET 1")),
        "pipeline_live_logistics": (lambda t: Q.pipeline_live(t.opps, AS_OF, agency="dla"), live("(agency LIKE '%LOGISTICS%' OR source_system = 'DLA')", "LIMIT 50")),
        "pipeline_live_domain_code": (lambda t: Q.pipeline_live(t.opps, AS_OF, domain="0004"), live("(psc LIKE '0004%' OR naics LIKE '0004%')", "LIMIT 50")),
        "pipeline_live_domain_text": (lambda t: Q.pipeline_live(t.opps, AS_OF, domain="and", platform="the"), live("(upper(title) LIKE '%AND%' OR upper(description) LIKE '%AND%') AND (upper(title) LIKE '%THE%' OR upper(description) LIKE '%THE%')", "LIMIT 50")),
        "pipeline_details": (lambda t: Q.pipeline_details(t.opps, "10385").select("id", "sol_num", "agency"), w("SELECT id, sol_num, agency FROM opps WHERE id = '10385' OR sol_num = '10385'", OPPS)),
        "search_global_part": (lambda t: Q.search_global(t.index, "000000012").select("place", "type", "label", "value", "sub_label", "cage"), w(f"SELECT 0 AS place, 'NSN' AS type, 'Lookup Part: 000000012' AS label, '000000012' AS value, 'Supply Chain Search' AS sub_label, NULL AS cage UNION ALL SELECT CAST(row_number() OVER (ORDER BY score DESC, cage) AS INTEGER), 'CHILD', label, cage, city || ', ' || state || ' • CAGE: ' || cage || ' • ' || {_MONEY_LABEL}, cage FROM (SELECT s.vendor_name AS label, s.cage_code AS cage, min(geo.city) AS city, min(geo.state) AS state, {money('total_spend')} AS score FROM s JOIN geo USING (cage_code) WHERE s.vendor_name LIKE '%000000012%' GROUP BY 1, 2 ORDER BY score DESC, cage LIMIT 8)", TX, S, GEO)),
        "search_global_sites": (lambda t: Q.search_global(t.index, "r#00000001"), w(f"SELECT CAST(row_number() OVER (ORDER BY score DESC, 'site-' || cage) AS INTEGER) AS place, 'site-' || cage AS key, 'CHILD' AS type, label, cage AS value, city || ', ' || state || ' • CAGE: ' || cage || ' • ' || {_MONEY_LABEL} AS sub_label, cage, score FROM (SELECT s.vendor_name AS label, s.cage_code AS cage, min(geo.city) AS city, min(geo.state) AS state, {money('total_spend')} AS score FROM s JOIN geo USING (cage_code) WHERE s.vendor_name LIKE '%R#00000001%' GROUP BY 1, 2 ORDER BY score DESC, 'site-' || cage LIMIT 8)", TX, S, GEO)),
        # older dashboards
        "legacy_kpis": (lambda t: Q.legacy_kpis(t.s, old()), w(f"SELECT {money('total_spend')} / 1e9 AS total_spend_b, {big('SUM(contract_count)')} AS total_contracts FROM s WHERE {OLD}", TX, S)),
        "legacy_trend": (lambda t: Q.legacy_trend(t.s, old()), w(f"SELECT year AS label, {money('total_spend')} / 1e9 AS spend FROM s WHERE {OLD} GROUP BY 1", TX, S)),
        "legacy_trend_monthly": (lambda t: Q.legacy_trend(t.s, old(), "monthly"), w(f"SELECT month AS label, {money('total_spend')} / 1e9 AS spend FROM s WHERE {OLD} GROUP BY 1", TX, S)),
        "legacy_top_vendors": (lambda t: Q.legacy_top_vendors(t.s, exact(YEARS, psc="0011")), w(f"SELECT vendor_name AS vendor, {money('total_spend')} / 1e6 AS spend_m, {big('SUM(contract_count)')} AS contracts FROM s WHERE year IN {YEAR_LIST} AND (psc_code = '0011' OR psc_description = '0011') GROUP BY 1 ORDER BY {money('total_spend')} DESC, 1 LIMIT 50", TX, S)),
        # scans, schemas, cleaning, windows
        "subset_scan": (lambda t: subset(t.tx, [contains_pattern(F.col("part_number"), "p_2")], ["contract_id", "line_no", "spend_amount", "action_date"], "spend_amount DESC, action_date DESC, contract_id, line_no ASC", 40, 3), w("SELECT contract_id, line_no, spend_amount, action_date FROM tx WHERE part_number LIKE '%P_2%' ORDER BY spend_amount DESC, action_date DESC, contract_id, line_no LIMIT 40 OFFSET 3", TX)),
        "schema_describe": (lambda t: io.describe(t.raw("part")).select("place", "column_name"), "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS place, column_name FROM (DESCRIBE SELECT * FROM part)"),
        "text_cleaning": (_cleaned, CLEANED),
        "parameterised_execute": (lambda t: io.run(t.spark, "SELECT p_brand, count(*) AS n FROM {t} WHERE p_size >= :least AND p_type = :kind GROUP BY 1".replace("{t}", f"parquet.`{t.dir}/part.parquet`"), {"least": 20, "kind": "ECONOMY"}), "SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 20 AND p_type = 'ECONOMY' GROUP BY 1"),
        "events_sliding": (lambda t: incremental.sliding_totals(t.raw("events")).drop("end"), f"SELECT start, event_type, {money('value')} AS total, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type, value FROM events) GROUP BY 1, 2"),
        "events_sessions": (lambda t: incremental.session_totals(t.raw("events")), f"""SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, {money('value')} AS total, count(*) AS n FROM (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events)) GROUP BY user_id, session"""),
        "events_distinct": (lambda t: incremental.distinct_events(t.raw("events").unionByName(t.raw("events"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, COUNT(DISTINCT event_id) AS n FROM events GROUP BY 1"),
    }
