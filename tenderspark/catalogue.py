"""The registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as N
from .operators import explorer
from .operators.filters import Filters
from .plans import dossiers as D
from .plans import marts as M
from .plans import queries as Q
from .plans.adapter import AS_OF, listings, management_data, solicitations, table, transactions, vendor_sites
from .sources import io
from .streaming import incremental
from .warehouse import Warehouse

NO = Filters()
PLATFORM, AGENCY, YEARS, PARENT, CAGE, NIIN, CONTRACT = "BRAND#11", "BUILDING", [1998, 1999], "NATION_3", "00003", "000000007", "7"
SEEK = (200000.0, "1998-06-01", "5")


class Tables:
    """Domain tables and marts over one folder.  Marts are built once, when asked for, and read from the warehouse afterwards;
    `stored=False` builds them within each query."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = True):
        self.spark, self.dir = spark, sf_dir
        self.house = Warehouse(spark, sf_dir) if stored else None

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def _mart(self, name: str, build: Callable[[], DataFrame], key: tuple[str, ...], partition_by: tuple[str, ...] = ()) -> DataFrame:
        return self.house.mart(name, build, key, partition_by) if self.house else build()

    @property
    def tx(self) -> DataFrame:
        return self._mart("transactions", lambda: transactions(self.spark, self.dir), ("contract_id", "line_no"), ("year",))

    @property
    def s(self) -> DataFrame:
        return self._mart("summary", lambda: M.summary(self.tx), ("cage_code", "year"))

    @property
    def kpis(self) -> DataFrame:
        return self._mart("kpis", lambda: M.kpis(self.s), ("cage_code", "year"))

    @property
    def geo(self) -> DataFrame:
        return M.geo(vendor_sites(self.spark, self.dir))

    @property
    def rolled(self) -> DataFrame:
        return self._mart("contracts_rolled", lambda: M.contracts_rolled(self.tx), ("contract_id",))

    @property
    def edges(self) -> DataFrame:
        return self._mart("network", lambda: M.network(self.tx), ("platform_family", "contract_id"))

    @property
    def profiles(self) -> DataFrame:
        return self._mart("profiles", lambda: M.profiles(self.s, self.edges), ("cage_code",))

    @property
    def flis(self) -> DataFrame:
        return management_data(self.spark, self.dir)

    @property
    def rows(self) -> DataFrame:
        return self._mart("product_rows", lambda: M.product_rows(self.tx), ("niin", "cage"))

    @property
    def platforms(self) -> DataFrame:
        return self._mart("part_platforms", lambda: M.part_platforms(self.tx), ("niin",))

    @property
    def products(self) -> DataFrame:
        return self._mart("products", lambda: M.products(self.rows, self.platforms, self.flis), ("niin", "cage"))

    @property
    def nsn(self) -> DataFrame:
        return self._mart("nsn_summary", lambda: M.nsn_summary(self.tx), ("niin", "year"))

    @property
    def sellers(self) -> DataFrame:
        return self._mart("nsn_supplier_lookup", lambda: M.nsn_supplier_lookup(self.tx), ("niin", "cage"))

    @property
    def lookup(self) -> DataFrame:
        return self._mart("nsn_profile_lookup", lambda: M.nsn_profile_lookup(self.rows, self.flis.drop("item_name")), ("niin",))

    @property
    def bom(self) -> DataFrame:
        p = self.raw("part")
        codes = p.select(F.upper("p_brand").alias("platform_family"), F.col("p_size").alias("code"))
        uses = p.select(F.col("p_size").alias("code"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("niin"))
        return self._mart("platform_bom", lambda: M.platform_bom(codes, uses), ("platform_family", "niin"))

    @property
    def opps(self) -> DataFrame:
        return self._mart("opportunities", lambda: M.opportunities(solicitations(self.spark, self.dir), AS_OF), ("deadline", "id"))

    @property
    def reference(self) -> DataFrame:
        rows = lambda: M.catalogue_rows(self.rows, listings(self.spark, self.dir))
        return self._mart("nsn_cage_reference", lambda: M.nsn_cage_reference(rows(), self.tx, self.platforms, self.flis.drop("item_name")), ("niin", "cage"))

    @property
    def index(self) -> DataFrame:
        return self._mart("search_index", lambda: M.search_index(self.s, self.geo, self.opps), ("type", "label"))

    @property
    def titles(self) -> DataFrame:
        """Titles of industry codes, by their first five digits."""
        code = F.substring(F.lpad(F.col("p_size").cast("string"), 6, "0"), 1, 5).alias("code")
        return self.raw("part").select(code).distinct().withColumn("title", F.concat(F.lit("title "), F.col("code")))

    @property
    def dirty(self) -> DataFrame:
        """Customers with null words and aliases put into them."""
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k, F.when(k % 7 == 0, " Boeing").when(k % 7 == 1, "the boeing ").otherwise(F.col("c_name")).alias("vendor_name"), F.when(k % 5 == 0, "nan").when(k % 5 == 1, F.lit(None)).otherwise(F.concat(F.lit(" c"), k)).alias("cage_code"),
            F.when(k % 3 == 0, "unknown").otherwise(F.col("c_mktsegment")).alias("sub_agency"), F.lit("NAN.0").alias("market_segment"), F.lit("f-16 ").alias("platform_family"), F.col("c_acctbal").alias("total_spend"))

    def build(self) -> None:
        """Publish every mart that is not there yet."""
        for name in ("kpis", "profiles", "products", "nsn", "sellers", "lookup", "bom", "reference", "rolled", "index"):
            getattr(self, name)


def money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


# Views for DuckDB, each named as the mart it stands for.
TX = """tx AS (
SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS action_date, upper(s_name) AS vendor_name, lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS vendor_cage,
 upper(sn.n_name) AS clean_parent, c_mktsegment AS sub_agency, cr.r_name AS parent_agency, p_name AS description, CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS DOUBLE) AS spend_amount,
 lpad(CAST(p_size AS VARCHAR), 6, '0') AS naics_code, lpad(CAST(p_size AS VARCHAR), 4, '0') AS psc, upper(p_type) AS psc_description, upper(p_brand) AS platform_family, upper(p_type) AS market_segment,
 CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
 CAST(1000 + p_size AS VARCHAR) || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS nsn, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS niin, 'P' || p_partkey AS part_number, 'CITY_' || s_nationkey AS city, upper(sr.r_name) AS state,
 l_quantity AS units, l_extendedprice AS price, l_returnflag AS pricing_type, l_linestatus AS competition_type, l_linenumber AS line_no, l_suppkey AS supp, l_partkey AS part
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN part ON l_partkey = p_partkey)"""
S = f"""s AS (SELECT vendor_name, vendor_cage AS cage_code, clean_parent, sub_agency, market_segment, platform_family, psc AS psc_code, psc_description, naics_code, description AS naics_description, city, state, month, year,
 {money("spend_amount")} AS total_spend, COUNT(DISTINCT contract_id) AS contract_count FROM tx GROUP BY ALL)"""
KPIS = f"k AS (SELECT cage_code, year, {money('total_spend')} AS total_spend, CAST(SUM(contract_count) AS BIGINT) AS contract_count FROM s GROUP BY 1, 2)"
GEO = "geo AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS cage_code, upper(s_name) AS vendor_name, s_nationkey * 3.0::DOUBLE - 36 AS latitude, s_nationkey * 7.0::DOUBLE - 84 AS longitude, 'CITY_' || s_nationkey AS city, 'ST_' || s_nationkey AS state FROM supplier)"
LAST = "vendor_name, vendor_cage, clean_parent, sub_agency, parent_agency, description, platform_family, market_segment, naics_code, psc, city, state, pricing_type, competition_type"
ROLLED = f"""rolled AS (SELECT a.*, {LAST} FROM (SELECT contract_id, max(action_date) AS last_action_date, min(action_date) AS start_date, {money("spend_amount")} AS total_spend, max(year) AS year FROM tx GROUP BY 1) a
 JOIN (SELECT contract_id, {LAST}, row_number() OVER (PARTITION BY contract_id ORDER BY action_date DESC, line_no DESC, supp DESC, part DESC, price DESC) AS rn FROM tx) b ON a.contract_id = b.contract_id AND rn = 1)"""
EDGES = """firsts AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY line_no, supp, part, price, action_date) AS rn FROM tx),
edges AS (SELECT f.vendor_name AS prime_name, t.vendor_name AS sub_name, f.clean_parent AS prime_gold_parent, t.clean_parent AS sub_gold_parent, f.vendor_cage AS prime_cage, t.vendor_cage AS sub_cage, t.contract_id, t.line_no, t.description,
 t.action_date, t.year, t.spend_amount AS subaward_value, t.city AS sub_city, t.state AS sub_state, r.platform_family, r.psc, r.market_segment
 FROM tx t JOIN firsts f ON t.contract_id = f.contract_id AND f.rn = 1 AND t.supp <> f.supp JOIN rolled r ON r.contract_id = t.contract_id)"""
ROWS = f"""by_year AS (SELECT niin, nsn, vendor_cage AS cage, part_number, description, year, {money("spend_amount")} AS amount, {money("units")} AS u, max(action_date) AS d FROM tx GROUP BY ALL),
prod AS (SELECT niin, nsn, cage, part_number, description, {money("amount")} AS total_revenue, {money("u")} AS total_units_sold, max(d) AS last_sold_date,
 string_agg(year || ':' || CAST(CAST(CAST(amount AS DECIMAL(18,4)) AS DECIMAL(20,2)) AS VARCHAR), '|' ORDER BY year) AS annual_revenue_trend FROM by_year GROUP BY ALL),
products AS (SELECT *, total_revenue / total_units_sold AS avg_unit_price, substr(nsn, 1, 4) AS fsc_code FROM prod)"""
FLIS = """flis AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS niin, 'D' || p_size % 5 AS demil_code, CAST(p_size % 3 AS VARCHAR) AS shelf_life_code, p_type AS mgmt_control_code, CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE 'PG' END AS unit_of_issue,
 upper(p_brand) AS source_of_supply, p_retailprice AS govt_estimated_price, substr(p_type, 1, 1) AS acquisition_advice_code FROM part)"""
LISTED = """listed AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS niin, CAST(1000 + p_size AS VARCHAR) || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS nsn,
 lpad(CAST(p_partkey * 7 % (SELECT greatest(1, count(*)) FROM supplier) AS VARCHAR), 5, '0') AS cage, 'P' || p_partkey AS part_number, p_name AS description FROM part),
listing AS (SELECT niin, nsn, cage, part_number, description, total_revenue, fsc_code FROM products UNION ALL
 SELECT niin, nsn, cage, part_number, description, 0.0::DOUBLE, substr(nsn, 1, 4) FROM listed l WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.niin = l.niin AND p.cage = l.cage))"""
PLAT = f"""pp AS (SELECT niin, platform_family, {money("spend_amount")} AS sp FROM tx GROUP BY ALL), plats AS (SELECT niin, arg_max(platform_family, sp) AS platform_family FROM pp GROUP BY 1)"""
NSN = f"nsn AS (SELECT niin, year, platform_family, market_segment, sub_agency, parent_agency, psc, {money('spend_amount')} AS spend_amount, COUNT(DISTINCT contract_id) AS contracts FROM tx GROUP BY ALL)"
LOOKUP = f"lookup AS (SELECT niin, year, vendor_cage AS cage, parent_agency, sub_agency, market_segment, platform_family, psc, contract_id, max(vendor_name) AS vendor, max(action_date) AS last_sold, {money('spend_amount')} AS total_revenue FROM tx GROUP BY ALL)"
OPPS = f"""opps AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'SPE-' ELSE 'SOL-' END || o_orderkey AS sol_num, split_part(text, chr(10), 1) AS title, c_mktsegment AS agency, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAY AS DATE) AS VARCHAR) AS deadline,
 o_orderpriority AS set_aside_type, lpad(CAST(o_orderkey % 50 + 1 AS VARCHAR), 6, '0') AS naics, lpad(CAST(o_orderkey % 50 + 1 AS VARCHAR), 4, '0') AS psc, text AS description,
 CASE WHEN o_orderkey % 10 = 0 THEN 'DLA' WHEN o_orderkey % 2 = 0 THEN 'DIBBS' ELSE 'SAM' END AS source_system, 'ST_' || (o_orderkey % 7) AS state
 FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN documents ON doc_id = o_orderkey % (SELECT greatest(1, count(*)) FROM documents) WHERE o_orderstatus = 'O' AND CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAY AS DATE) >= DATE '{AS_OF}')"""
PROFILES = f"""sold AS (SELECT cage_code, arg_max(vendor_name, (year, total_spend, vendor_name)) AS vendor_name, {money('total_spend')} AS total_lifetime_spend, CAST(SUM(contract_count) AS BIGINT) AS total_contracts, max(year) AS last_active_year,
 array_to_string(list_sort(list(DISTINCT naics_code || ' - ' || naics_description))[1:5], ', ') AS top_naics_codes, array_to_string(list_sort(list(DISTINCT platform_family))[1:5], ', ') AS top_platforms FROM s WHERE cage_code <> '00000' GROUP BY 1),
flow AS (SELECT cage_code, arg_max(vendor_name, (year, v, vendor_name)) AS vendor_name, {money('v')} AS network_flow_total, COUNT(DISTINCT contract_id) AS network_contract_count, max(year) AS network_last_active_year
 FROM (SELECT prime_cage AS cage_code, prime_name AS vendor_name, contract_id, year, subaward_value AS v FROM edges UNION ALL SELECT sub_cage, sub_name, contract_id, year, subaward_value FROM edges) WHERE cage_code <> '00000' GROUP BY 1),
profiles AS (SELECT coalesce(a.cage_code, n.cage_code) AS cage_code, coalesce(a.vendor_name, n.vendor_name) AS vendor_name, coalesce(total_lifetime_spend, 0) AS total_lifetime_spend, coalesce(total_contracts, 0) AS total_contracts, coalesce(last_active_year, 0) AS last_active_year, top_naics_codes, top_platforms,
 CASE WHEN a.cage_code IS NOT NULL AND n.cage_code IS NOT NULL THEN 'AWARD_AND_NETWORK' WHEN a.cage_code IS NOT NULL THEN 'AWARD_BACKED' ELSE 'NETWORK_ONLY' END AS profile_source, coalesce(network_flow_total, 0) AS network_flow_total, coalesce(network_contract_count, 0) AS network_contract_count, coalesce(network_last_active_year, 0) AS network_last_active_year
 FROM sold a FULL JOIN flow n ON a.cage_code = n.cage_code)"""
BOM = """bom AS (SELECT DISTINCT upper(a.p_brand) AS platform_family, lpad(CAST(b.p_partkey AS VARCHAR), 9, '0') AS niin FROM (SELECT DISTINCT p_brand, p_size FROM part) a JOIN part b ON a.p_size = b.p_size)"""


def w(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)}\n{body}" if views else body


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


YEAR_LIST = "(1998, 1999)"
_SPEND = f"{money('total_spend')} AS total_spend"
_CONTRACTS = f"{big('SUM(contract_count)')} AS contracts"
OPEN_CAGE = f"cage_code = '{CAGE}'"
SUM_TREND = "list_sum(list_transform(list_filter(string_split(annual_revenue_trend, '|'), lambda x: split_part(x, ':', 1) IN ('1998', '1999')), lambda x: split_part(x, ':', 2)::DOUBLE))"
MERGED = "SELECT niin, string_agg(y || ':' || CAST(a AS VARCHAR), '|' ORDER BY y) AS annual_revenue_trend FROM (SELECT niin, split_part(x, ':', 1) AS y, SUM(CAST(split_part(x, ':', 2) AS DECIMAL(20,2))) AS a FROM (SELECT niin, unnest(string_split(annual_revenue_trend, '|')) AS x FROM products) GROUP BY ALL) GROUP BY 1"


PART_LOOKUP = f"""part_lookup AS (SELECT p.niin, max(nsn) AS nsn, max(description) AS item_name, max(fsc_code) AS fsc_code, {money('total_revenue')} AS total_revenue, {money('total_units_sold')} AS total_units_sold,
 round(CAST(SUM(CAST(avg_unit_price * total_units_sold AS DECIMAL(24,4))) AS DOUBLE) / {money('total_units_sold')}, 4) AS market_price, max(last_sold_date) AS last_sold_date, min(m.annual_revenue_trend) AS annual_revenue_trend,
 {', '.join(f'max({c}) AS {c}' for c in M.MANAGEMENT)} FROM products p JOIN ({MERGED}) m ON m.niin = p.niin JOIN flis ON flis.niin = p.niin WHERE total_revenue > 0 GROUP BY 1)"""


def _dist(column: str, where: str = "true") -> str:
    return w(f"""SELECT label, value, round(value * 100 / total, 1) AS pct FROM (SELECT label, value FROM first UNION ALL
 SELECT 'Other', CAST(CAST((SELECT total FROM tot) AS DECIMAL(18,4)) - CAST((SELECT sum(CAST(value AS DECIMAL(18,4))) FROM first) AS DECIMAL(18,4)) AS DOUBLE)), tot WHERE value > 0""", TX, S,
        f"g AS (SELECT {column} AS label, {money('total_spend')} AS value FROM s WHERE {where} GROUP BY 1)", f"tot AS (SELECT {money('value')} AS total FROM g)", "first AS (SELECT * FROM g ORDER BY value DESC, label LIMIT 4)")


def _gap(source: str) -> str:
    return f"SELECT CAST(y AS INTEGER) AS year, coalesce(amount, 0.0::DOUBLE) AS amount FROM (SELECT unnest(range((SELECT min(year) FROM {source}), (SELECT max(year) FROM {source}) + 1)) AS y) LEFT JOIN {source} ON y = year"


_MONEY_LABEL = "CASE WHEN score <= 0 THEN '' WHEN score >= 1e9 THEN format('${:,.1f}B', score / 1e9) WHEN score >= 1e6 THEN format('${:,.1f}M', score / 1e6) ELSE format('${:,.0f}K', score / 1e3) END"


def _live(where: str, page: str) -> str:
    return f"SELECT id, sol_num, agency, deadline, CAST(date_diff('day', DATE '{AS_OF}', CAST(deadline AS DATE)) AS INTEGER) AS days_left, source_system, (SELECT count(*) FROM opps WHERE {where}) AS total_matches FROM opps WHERE {where} ORDER BY deadline, id {page}"


def _own_parts(amount: str, where: str) -> str:
    return f"own AS (SELECT *, {amount} AS amount FROM products WHERE {where} AND niin IN (SELECT niin FROM bom WHERE platform_family = '{PLATFORM}'))"


PLATFORM_PARTS = f"""SELECT a.niin, a.nsn, a.description, a.fsc_code, a.cage, b.amount, b.total_units_sold, b.last_sold_date, m.annual_revenue_trend FROM (SELECT *, row_number() OVER (PARTITION BY niin ORDER BY amount DESC, cage, part_number) AS rn FROM own) a
 JOIN (SELECT niin, {money('amount')} AS amount, CAST({money('total_units_sold')} AS BIGINT) AS total_units_sold, max(last_sold_date) AS last_sold_date FROM own GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) b ON a.niin = b.niin AND rn = 1 JOIN ({MERGED}) m ON m.niin = a.niin"""


# Words between boundaries that know all letters: each other character becomes two blanks, and a word stands between two.
TOPICS = rf"""WITH RECURSIVE t AS (SELECT conv_id AS feed, turn AS pos, text AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn,
 list_distinct(list_filter(list_transform(regexp_extract_all('  ' || regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '  ', 'g') || '  ', ' ([A-Z][a-z]+|[A-Z]+) ', 1), lambda x: upper(x)), lambda x: length(x) > 2 AND NOT list_contains([{", ".join(f"'{x}'" for x in Q.GENERIC)}], x))) AS topics FROM conversations WHERE text IS NOT NULL),
r AS (SELECT DISTINCT feed, 0::BIGINT AS rn, 0 AS kept, false AS take, []::VARCHAR[] AS seen FROM t
 UNION ALL SELECT t.feed, t.rn, kept + CASE WHEN kept < 6 AND NOT list_has_any(seen, topics) THEN 1 ELSE 0 END, kept < 6 AND NOT list_has_any(seen, topics), CASE WHEN kept < 6 AND NOT list_has_any(seen, topics) THEN list_concat(seen, topics) ELSE seen END FROM r JOIN t ON t.feed = r.feed AND t.rn = r.rn + 1)
SELECT feed, pos, title FROM r JOIN t USING (feed, rn) WHERE take"""


def _entries() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    f_plat, f_years = Filters(platform=PLATFORM), Filters(years=YEARS)
    award = "total_spend, last_action_date, contract_id, vendor_name, sub_agency"
    award_order = "ORDER BY total_spend DESC, last_action_date DESC, contract_id DESC"
    return {
        # dashboard
        "top_vendors": (lambda t: Q.top_vendors(t.s, NO), w(f"SELECT clean_parent, {_SPEND}, {_CONTRACTS}, {money('total_spend')} / 1e6 AS spend_m FROM s GROUP BY 1 ORDER BY total_spend DESC, clean_parent LIMIT 50", TX, S)),
        "market_kpis": (lambda t: Q.kpis(t.s, Filters(years=YEARS, agency=AGENCY)), w(f"SELECT {money('total_spend')} / 1e9 AS total_spend_b, {big('SUM(contract_count)')} AS total_contracts FROM s WHERE year IN {YEAR_LIST} AND sub_agency = '{AGENCY}'", TX, S)),
        "filter_options_agencies": (lambda t: Q.options(t.s, "sub_agency", f_plat), w(f"SELECT DISTINCT sub_agency FROM s WHERE platform_family = '{PLATFORM}'", TX, S)),
        "filter_options_psc_pairs": (lambda t: Q.psc_pairs(t.s, f_years), w(f"SELECT DISTINCT psc_code, psc_description FROM s WHERE year IN {YEAR_LIST}", TX, S)),
        "filter_options_parents": (lambda t: Q.top_parents(t.s, f_years), w(f"SELECT clean_parent, {_SPEND} FROM s WHERE year IN {YEAR_LIST} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", TX, S)),
        "options_years": (lambda t: Q.options(t.s, "year"), w("SELECT DISTINCT year FROM s", TX, S)),
        "trend_yearly_gapfilled": (lambda t: Q.trend_yearly(t.s, f_plat), w(_gap("g"), TX, S, f"g AS (SELECT year, {money('total_spend')} AS amount FROM s WHERE platform_family = '{PLATFORM}' GROUP BY 1)")),
        "trend_yearly": (lambda t: Q.trend_yearly(t.s, Filters(agency=AGENCY)), w(_gap("g"), TX, S, f"g AS (SELECT year, {money('total_spend')} AS amount FROM s WHERE sub_agency = '{AGENCY}' GROUP BY 1)")),
        "trend_monthly_fiscal": (lambda t: Q.trend_monthly(t.s, f_years), w(f"SELECT month, {_SPEND}, CAST(CASE WHEN month >= 10 THEN month - 9 ELSE month + 3 END AS INTEGER) AS place FROM s WHERE year IN {YEAR_LIST} GROUP BY month", TX, S)),
        "subsidiaries": (lambda t: Q.subsidiaries(t.s, t.geo, Filters(parent=PARENT)), w(f"SELECT s.cage_code, s.vendor_name, {_SPEND}, {_CONTRACTS}, coalesce(min(geo.city), 'N/A') AS city, coalesce(min(geo.state), 'N/A') AS state FROM s LEFT JOIN geo USING (cage_code) WHERE clean_parent = '{PARENT}' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 200", TX, S, GEO)),
        "distributions_platform": (lambda t: Q.distribution(t.s, "platform_family", f_years), _dist("platform_family", f"year IN {YEAR_LIST}")),
        "distributions_psc": (lambda t: Q.distribution(t.s, "psc_description", NO), _dist("psc_description")),
        "legacy_distribution": (lambda t: Q.legacy_distribution(t.s, "platform_family", NO), w(f"SELECT label, value, round(value * 100 / (SELECT {money('value')} FROM g), 1) AS pct FROM (SELECT CASE WHEN rn <= 5 THEN label ELSE 'Other' END AS label, {money('value')} AS value FROM g GROUP BY 1)", TX, S, f"g AS (SELECT platform_family AS label, {money('total_spend')} AS value, row_number() OVER (ORDER BY {money('total_spend')} DESC, platform_family) AS rn FROM s GROUP BY 1)")),
        "legacy_map": (lambda t: Q.legacy_map(t.s, t.geo, NO), w(f"SELECT g.*, latitude, longitude FROM (SELECT cage_code, vendor_name, {_SPEND} FROM s GROUP BY 1, 2) g JOIN geo USING (cage_code) WHERE total_spend > 1e6 ORDER BY total_spend DESC, cage_code LIMIT 50000".replace("g.*", "g.cage_code, g.vendor_name, g.total_spend"), TX, S, GEO)),
        "legacy_details": (lambda t: Q.details(t.tx, "SUPPLIER#000000003", "1998-0"), w("SELECT contract_id, action_date, line_no, part_number, spend_amount FROM tx WHERE vendor_name = 'SUPPLIER#000000003' AND action_date LIKE '1998-0%' ORDER BY action_date, contract_id, line_no, part_number, spend_amount LIMIT 100", TX)),
        "legacy_vendor_groups": (lambda t: Q.vendor_groups(t.s), w(f"SELECT vendor_name, CASE WHEN row_number() OVER (ORDER BY {money('total_spend')} DESC, vendor_name) <= 50 THEN 'top' ELSE 'rest' END AS part FROM s GROUP BY 1", TX, S)),
        "map_points": (lambda t: Q.map_points(t.s, t.geo, NO), w(f"SELECT g.cage, vendor, total_spend, latitude, longitude, city, state FROM (SELECT cage_code AS cage, max(vendor_name) AS vendor, {_SPEND} FROM s GROUP BY 1) g JOIN geo ON cage = cage_code ORDER BY total_spend DESC, cage LIMIT 50000", TX, S, GEO)),
        "recompete_kpi": (lambda t: Q.recompete(M.risk(M.risk_sidecar(t.rolled), t.rolled), AS_OF), w(f"SELECT coalesce({money('total_spend')}, 0) AS value, COUNT(DISTINCT contract_id) AS contracts, round(coalesce({money('total_spend')}, 0) / 1e9, 6) AS value_b FROM rolled WHERE CAST(last_action_date AS DATE) BETWEEN DATE '{AS_OF}' AND CAST(DATE '{AS_OF}' + INTERVAL 90 DAY AS DATE)", TX, ROLLED)),
        "threshold_filter": (lambda t: t.kpis.where(Filters(threshold_m=2.25).column()), w("SELECT * FROM k WHERE total_spend >= 2250000", TX, S, KPIS)),
        # awards
        "contracts_rolled": (lambda t: t.rolled, w("SELECT * FROM rolled", TX, ROLLED)),
        "award_search_page": (lambda t: Q.award_search(t.rolled, "ring", [F.col("sub_agency") == AGENCY]), w(f"SELECT {award} FROM rolled WHERE sub_agency = '{AGENCY}' AND (contract_id LIKE '%RING%' OR upper(vendor_name) LIKE '%RING%' OR upper(description) LIKE '%RING%' OR psc LIKE '%RING%') {award_order} LIMIT 51", TX, ROLLED)),
        "award_search_keyset_next": (lambda t: Q.award_search(t.rolled, filters=[F.col("year") >= 1996], seek=SEEK), w(f"SELECT {award} FROM rolled WHERE year >= 1996 AND (total_spend < {SEEK[0]} OR (total_spend = {SEEK[0]} AND (last_action_date < '{SEEK[1]}' OR (last_action_date = '{SEEK[1]}' AND contract_id < '{SEEK[2]}')))) {award_order} LIMIT 51", TX, ROLLED)),
        "award_search_default_view": (lambda t: Q.award_search(t.rolled, as_of=AS_OF, least=2e5), w(f"SELECT {award} FROM rolled WHERE total_spend >= 2e5 AND CAST(last_action_date AS DATE) >= CAST(DATE '{AS_OF}' - INTERVAL 730 DAY AS DATE) {award_order} LIMIT 51", TX, ROLLED)),
        "award_profile": (lambda t: Q.award_profile(t.rolled, CONTRACT), w(f"SELECT *, sub_agency AS agency FROM rolled WHERE contract_id = '{CONTRACT}'", TX, ROLLED)),
        "award_history": (lambda t: Q.award_history(t.tx, CONTRACT), w(f"SELECT contract_id, action_date, line_no, vendor_name, part_number, spend_amount FROM tx WHERE contract_id = '{CONTRACT}' ORDER BY action_date, line_no, part_number, spend_amount LIMIT 200", TX)),
        "award_stats": (lambda t: t.spark.createDataFrame([(io.row_count(t.spark, io.current(t.spark, f"{t.house.root}/contracts_rolled")),)] if t.rolled else [], "n long"), w("SELECT count(*) AS n FROM rolled", TX, ROLLED)),
        "recent_wins": (lambda t: Q.recent_wins(t.tx, AS_OF, 50000), w(f"SELECT contract_id, action_date, line_no, vendor_name, part_number, spend_amount FROM tx WHERE CAST(action_date AS DATE) >= CAST(DATE '{AS_OF}' - INTERVAL 180 DAY AS DATE) AND spend_amount > 50000 ORDER BY action_date DESC, spend_amount DESC, contract_id, line_no, part_number LIMIT 50", TX)),
        "company_awards": (lambda t: Q.awards_page(t.tx, [F.col("vendor_cage") == CAGE], 50, 10), w(f"SELECT contract_id, action_date, line_no, vendor_cage, part_number, coalesce(sub_agency, parent_agency) AS agency, spend_amount FROM tx WHERE vendor_cage = '{CAGE}' ORDER BY spend_amount DESC, action_date DESC, contract_id, line_no, part_number, vendor_cage LIMIT 50 OFFSET 10", TX)),
        "platform_awards": (lambda t: Q.awards_page(t.tx, [F.col("platform_family") == PLATFORM, (F.col("sub_agency") == AGENCY) | (F.col("parent_agency") == AGENCY)], 40, by_date=True), w(f"SELECT contract_id, action_date, line_no, vendor_cage, part_number, coalesce(sub_agency, parent_agency) AS agency, spend_amount FROM tx WHERE platform_family = '{PLATFORM}' AND (sub_agency = '{AGENCY}' OR parent_agency = '{AGENCY}') ORDER BY action_date DESC, spend_amount DESC, contract_id, line_no, part_number, vendor_cage LIMIT 40", TX)),
        # platforms
        "platform_top": (lambda t: Q.platform_top(t.s, NO), w(f"SELECT platform_family, {_SPEND}, {_CONTRACTS} FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", TX, S)),
        "platform_profile_totals": (lambda t: Q.platform_totals(t.s, PLATFORM), w(f"SELECT {_SPEND}, {_CONTRACTS}, COUNT(DISTINCT vendor_name) AS vendors, (SELECT sub_agency FROM s WHERE platform_family = '{PLATFORM}' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS usual_agency FROM s WHERE platform_family = '{PLATFORM}'", TX, S)),
        "platform_profile_vendors": (lambda t: Q.platform_vendors(t.s, PLATFORM), w(f"SELECT cage_code, vendor_name, {_SPEND}, {_CONTRACTS}, 'PRIME' AS role FROM s WHERE platform_family = '{PLATFORM}' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", TX, S)),
        "platform_profile_agencies": (lambda t: Q.platform_agencies(t.s, PLATFORM), w(f"SELECT sub_agency, {_SPEND} FROM s WHERE platform_family = '{PLATFORM}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", TX, S)),
        "platform_contractors_page": (lambda t: Q.platform_vendors(t.s, PLATFORM, 20, 15), w(f"SELECT cage_code, vendor_name, {_SPEND}, {_CONTRACTS}, 'PRIME' AS role FROM s WHERE platform_family = '{PLATFORM}' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20 OFFSET 15", TX, S)),
        "platform_parts_rollup": (lambda t: Q.platform_parts(t.products, t.bom, PLATFORM, limit=50, zero=False), w(PLATFORM_PARTS, TX, ROWS, BOM, _own_parts("total_revenue", "total_revenue > 0"))),
        "platform_parts_count": (lambda t: Q.bom_count(t.bom, PLATFORM), w(f"SELECT COUNT(DISTINCT niin) AS n FROM bom WHERE platform_family = '{PLATFORM}'", BOM)),
        "platform_bom": (lambda t: t.bom, w("SELECT * FROM bom", BOM)),
        "subcontracts_rollup": (lambda t: Q.subcontracts(t.edges, t.tx.groupBy(F.col("psc").alias("psc_code")).agg(F.min("psc_description").alias("psc_description")), PLATFORM), w(f"""SELECT sub_name, sub_cage, prime_name, prime_cage, g.psc || ' - ' || psc_description AS psc_label, array_to_string(d[1:3], ', ') AS descriptions, n, value, last_date
 FROM (SELECT sub_name, sub_cage, prime_name, prime_cage, max(psc) AS psc, list_sort(list(DISTINCT description)) AS d, count(*) AS n, {money('subaward_value')} AS value, max(action_date) AS last_date FROM edges WHERE platform_family = '{PLATFORM}' GROUP BY 1, 2, 3, 4 ORDER BY value DESC, sub_cage, prime_cage LIMIT 50) g
 JOIN (SELECT psc, min(psc_description) AS psc_description FROM tx GROUP BY 1) p ON p.psc = g.psc""", TX, ROLLED, EDGES)),
        "subcontracts_lines": (lambda t: Q.subcontract_lines(t.edges, PLATFORM), w(f"SELECT contract_id, line_no, prime_cage, sub_cage, description, action_date, subaward_value FROM edges WHERE platform_family = '{PLATFORM}' ORDER BY subaward_value DESC, contract_id, line_no, sub_cage, action_date, description LIMIT 50", TX, ROLLED, EDGES)),
        "supply_chain_single_platform": (lambda t: Q.supply_chain(t.edges, PLATFORM), w(f"SELECT sub_name, sub_cage, sub_city, sub_state, prime_name, count(*) AS n, {money('subaward_value')} AS value FROM edges WHERE platform_family = '{PLATFORM}' GROUP BY ALL", TX, ROLLED, EDGES)),
        # network and companies
        "network_edges": (lambda t: t.edges, w("SELECT * FROM edges", TX, ROLLED, EDGES)),
        "network_subs": (lambda t: Q.company_network(t.edges, "X", CAGE), w(f"SELECT sub_name AS name, sub_cage AS cage, min(platform_family) AS platform, {money('subaward_value')} AS total, count(contract_id) AS contracts FROM edges WHERE prime_cage = '{CAGE}' GROUP BY 1, 2 ORDER BY 4 DESC, 2, 1 LIMIT 50", TX, ROLLED, EDGES)),
        "network_primes": (lambda t: Q.company_network(t.edges, "X", CAGE, "primes"), w(f"SELECT prime_name AS name, prime_cage AS cage, min(platform_family) AS platform, {money('subaward_value')} AS total, count(contract_id) AS contracts FROM edges WHERE sub_cage = '{CAGE}' GROUP BY 1, 2 ORDER BY 4 DESC, 2, 1 LIMIT 50", TX, ROLLED, EDGES)),
        "network_parent_mode": (lambda t: Q.company_network(t.edges, PARENT, "AGGREGATE"), w(f"SELECT sub_name AS name, sub_cage AS cage, min(platform_family) AS platform, {money('subaward_value')} AS total, count(contract_id) AS contracts FROM edges WHERE prime_gold_parent = '{PARENT}' GROUP BY 1, 2 ORDER BY 4 DESC, 2, 1 LIMIT 50", TX, ROLLED, EDGES)),
        "profiles_full_outer": (lambda t: t.profiles.fillna(0, ["last_active_year", "network_last_active_year"]), w("SELECT * FROM profiles", TX, S, ROLLED, EDGES, PROFILES)),
        "profiles": (lambda t: t.profiles.fillna(0, ["last_active_year", "network_last_active_year"]), w("SELECT * FROM profiles", TX, S, ROLLED, EDGES, PROFILES)),
        "profile_pick_name": (lambda t: M.pick_name(t.tx.select("clean_parent", "vendor_name", "year", "spend_amount"), "clean_parent", "spend_amount"), w("SELECT clean_parent, vendor_name FROM (SELECT *, row_number() OVER (PARTITION BY clean_parent ORDER BY year DESC, spend_amount DESC, vendor_name DESC) AS rn FROM tx) WHERE rn = 1", TX)),
        "company_kpis_year": (lambda t: Q.company_kpis(t.kpis, CAGE, YEARS), w(f"SELECT {_SPEND}, {_CONTRACTS}, max(year) AS last_year FROM s WHERE {OPEN_CAGE} AND year IN {YEAR_LIST}", TX, S)),
        "kpis_mart": (lambda t: t.kpis, w("SELECT * FROM k", TX, S, KPIS)),
        "parent_aggregate": (lambda t: Q.parent_aggregate(t.s, PARENT), w(f"SELECT {_SPEND}, {_CONTRACTS}, max(year) AS last_year FROM s WHERE clean_parent = '{PARENT}'", TX, S)),
        "parent_top_naics": (lambda t: Q.parent_top_naics(t.s, PARENT), w(f"SELECT naics_code || ' - ' || naics_description AS naics, count(*) AS n FROM s WHERE clean_parent = '{PARENT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", TX, S)),
        "company_teaser_shares": (lambda t: Q.shares(t.s, CAGE, "platform_family"), w(f"SELECT label, value, CAST(least(100, floor(value * 100 / total)) AS INTEGER) AS pct, greatest(0, n - 3) AS hidden FROM (SELECT platform_family AS label, {money('total_spend')} AS value FROM s WHERE {OPEN_CAGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), (SELECT {money('total_spend')} AS total, COUNT(DISTINCT platform_family) AS n FROM s WHERE {OPEN_CAGE})", TX, S)),
        "company_parts_flat": (lambda t: Q.company_parts(t.products, CAGE, YEARS), w(f"SELECT niin, cage, part_number, description, coalesce({SUM_TREND}, 0) AS amount, last_sold_date FROM products WHERE cage = '{CAGE}' AND total_revenue > 0 ORDER BY amount DESC, niin, part_number LIMIT 50", TX, ROWS)),
        "company_parts_rollup": (lambda t: Q.company_parts(t.products, CAGE, rollup=True), w(f"""SELECT niin AS niin_key, {money('total_revenue')} AS amount, max(last_sold_date) AS last_sold_date, round({money('total_units_sold')} * 0 + CAST(SUM(CAST(avg_unit_price * total_units_sold AS DECIMAL(24,4))) AS DOUBLE) / {money('total_units_sold')}, 4) AS price,
 array_to_string(list_sort(list(DISTINCT part_number)), ',') AS part_numbers, COUNT(DISTINCT part_number) AS part_count, min(annual_revenue_trend) AS annual_revenue_trend FROM products WHERE cage = '{CAGE}' AND total_revenue > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", TX, ROWS)),
        "company_parts_count": (lambda t: Q.company_parts_count(t.products, CAGE), w(f"SELECT count(*) AS rows, COUNT(DISTINCT niin) AS niins FROM products WHERE cage = '{CAGE}' AND total_revenue > 0", TX, ROWS)),
        # parts
        "nsn_summary": (lambda t: t.nsn, w("SELECT niin, year, platform_family, market_segment, upper(sub_agency) AS sub_agency, upper(parent_agency) AS parent_agency, psc, spend_amount, contracts FROM nsn", TX, NSN)),
        "nsn_profile_lookup": (lambda t: t.lookup.withColumn("market_price", F.round("market_price", 4)), w("SELECT * FROM part_lookup", TX, ROWS, FLIS, PART_LOOKUP)),
        "nsn_trend_encode": (lambda t: t.rows.select("niin", "cage", "annual_revenue_trend"), w("SELECT niin, cage, annual_revenue_trend FROM products", TX, ROWS)),
        "nsn_trend_sum_years": (lambda t: t.rows.select("niin", "cage", F.round(N.trend_sum(F.col("annual_revenue_trend"), YEARS), 2).alias("amount")), w(f"SELECT niin, cage, round(coalesce({SUM_TREND}, 0), 2) AS amount FROM products", TX, ROWS)),
        "nsn_supplier_lookup": (lambda t: t.sellers, w("SELECT * FROM lookup", TX, LOOKUP)),
        "nsn_suppliers": (lambda t: Q.nsn_suppliers(t.sellers, t.reference, NIIN, t.geo), w(f"""SELECT coalesce(a.cage, b.cage) AS cage, vendor, coalesce(contracts, 0) AS contracts, last_sold, coalesce(revenue, 0) AS revenue, b.cage IS NOT NULL AS approved, coalesce(part_numbers, '\u2014') AS part_numbers, source
 FROM (SELECT cage, max(vendor) AS vendor, COUNT(DISTINCT contract_id) AS contracts, max(last_sold) AS last_sold, {money('total_revenue')} AS revenue FROM lookup WHERE niin = '{NIIN}' GROUP BY 1) a
 FULL JOIN (SELECT cage, string_agg(DISTINCT part_number, ', ') AS part_numbers, 'x' AS source FROM listing WHERE niin = '{NIIN}' AND NOT EXISTS (SELECT 1 FROM lookup WHERE niin = '{NIIN}') GROUP BY 1) b ON a.cage = b.cage""", TX, ROWS, LISTED, LOOKUP)),
        "nsn_supplier_reference_union": (lambda t: Q.supplier_union(t.sellers, t.reference, NIIN), w(f"SELECT cage, {money('total_revenue')} AS revenue, 'SALES' AS source FROM lookup WHERE niin = '{NIIN}' GROUP BY 1 UNION ALL SELECT DISTINCT cage, 0.0::DOUBLE, 'REFERENCE' FROM listing WHERE niin = '{NIIN}' AND cage NOT IN (SELECT cage FROM lookup WHERE niin = '{NIIN}')", TX, ROWS, LISTED, LOOKUP)),
        "nsn_supplier_union": (lambda t: Q.supplier_union(t.sellers, t.reference, "000000011"), w(f"SELECT cage, {money('total_revenue')} AS revenue, 'SALES' AS source FROM lookup WHERE niin = '000000011' GROUP BY 1 UNION ALL SELECT DISTINCT cage, 0.0::DOUBLE, 'REFERENCE' FROM listing WHERE niin = '000000011' AND cage NOT IN (SELECT cage FROM lookup WHERE niin = '000000011')", TX, ROWS, LISTED, LOOKUP)),
        "nsn_platforms": (lambda t: Q.nsn_platforms(t.nsn, NIIN), w(f"SELECT platform_family, {money('spend_amount')} AS spend, {big('SUM(contracts)')} AS contracts FROM nsn WHERE niin = '{NIIN}' GROUP BY 1", TX, NSN)),
        "nsn_history_gapfilled": (lambda t: Q.nsn_history(t.nsn, NIIN), w(_gap("g"), TX, NSN, f"g AS (SELECT year, {money('spend_amount')} AS amount FROM nsn WHERE niin = '{NIIN}' GROUP BY 1)")),
        "nsn_contracts_page": (lambda t: Q.nsn_contracts(t.tx, NIIN, 10, 5), w(f"SELECT contract_id, action_date, line_no, vendor_name AS vendor, platform_family AS platform, spend_amount FROM tx WHERE niin = '{NIIN}' ORDER BY action_date DESC, contract_id, line_no, spend_amount DESC, vendor LIMIT 10 OFFSET 5", TX)),
        "nsn_top": (lambda t: Q.nsn_top(t.tx, t.flis), w(f"SELECT niin, {money('spend_amount')} AS spend, COUNT(DISTINCT contract_id) AS contracts, max(description) AS name FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16", TX)),
        "nsn_reference_catalogue": (lambda t: t.reference, w(f"""SELECT p.niin, nsn, fsc_code, cage, description, part_number, total_revenue, flis.* EXCLUDE (niin), observed_spend, observed_contract_count, observed_row_count, first_observed_year, last_observed_year, last_observed_date, total_revenue > 0 AS has_observed_revenue,
 CASE WHEN total_revenue > 0 THEN 'REVENUE_LINKED' ELSE 'REFERENCE_ONLY' END AS revenue_status, platform_family, upper(nsn || ' ' || cage || ' ' || part_number || ' ' || description) AS search_text FROM listing p JOIN flis ON flis.niin = p.niin
 LEFT JOIN (SELECT niin, {money('spend_amount')} AS observed_spend, COUNT(DISTINCT contract_id) AS observed_contract_count, count(*) AS observed_row_count, min(year) AS first_observed_year, max(year) AS last_observed_year, max(action_date) AS last_observed_date FROM tx GROUP BY 1) o ON o.niin = p.niin LEFT JOIN plats ON plats.niin = p.niin""", TX, ROWS, LISTED, FLIS, PLAT)),
        "nsn_reference_profile": (lambda t: D.reference_profile(t.reference, NIIN), w(f"SELECT count(*) AS reference_rows, max(nsn) AS nsn, max(description) AS item_name, max(fsc_code) AS fsc_code, COUNT(DISTINCT cage) AS reference_supplier_count, COUNT(DISTINCT part_number) AS reference_part_count, string_agg(DISTINCT CASE WHEN total_revenue > 0 THEN 'REVENUE_LINKED' ELSE 'REFERENCE_ONLY' END, ', ' ORDER BY CASE WHEN total_revenue > 0 THEN 'REVENUE_LINKED' ELSE 'REFERENCE_ONLY' END) AS reference_sources FROM listing WHERE niin = '{NIIN}'", TX, ROWS, LISTED)),
        "products_with_platform": (lambda t: t.products.select("niin", "cage", "total_revenue", "platform_family", "item_name"), w("SELECT p.niin, cage, total_revenue, platform_family, description AS item_name FROM products p JOIN plats ON p.niin = plats.niin WHERE total_revenue > 0", TX, ROWS, PLAT)),
        # opportunities and search
        "opportunities_open": (lambda t: t.opps.select("id", "sol_num", "agency", "deadline", "naics", "search_text"), w("SELECT id, sol_num, agency, deadline, naics, replace(upper(concat_ws(' ', coalesce(title, ''), agency, sol_num, coalesce(description, ''))), chr(7838), 'SS') AS search_text FROM opps", OPPS)),
        "opportunities_total_over": (lambda t: Q.open_opportunities(t.opps, AS_OF, AGENCY, ["the"]), w(f"SELECT id, sol_num, agency, deadline, count(*) OVER () AS total FROM opps WHERE upper(agency) LIKE '%{AGENCY}%' AND (upper(title) LIKE '%THE%' OR upper(description) LIKE '%THE%') ORDER BY deadline NULLS LAST, id LIMIT 50", OPPS)),
        "opportunities_naics_prefix": (lambda t: Q.naics_matches(t.opps, ["00001", "00003", "12", "x"], AS_OF), w("SELECT id, naics, agency, deadline FROM opps WHERE naics LIKE '00001%' OR naics LIKE '00003%' ORDER BY deadline NULLS LAST, id LIMIT 50", OPPS)),
        "pipeline_live": (lambda t: Q.pipeline_live(t.opps, AS_OF, agency=AGENCY, source="SAM", naics="0000", limit=20, offset=3), w(_live(f"upper(agency) LIKE '%{AGENCY}%' AND source_system = 'SAM' AND naics LIKE '%0000%'", "LIMIT 20 OFFSET 3"), OPPS)),
        "solicitation_lookup": (lambda t: Q.solicitation(solicitations(t.spark, t.dir), "sol-50").select("id", "sol_num"), "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'SOL-' || o_orderkey AS sol_num FROM orders WHERE o_orderstatus = 'O' AND o_orderkey = 50"),
        "search_index": (lambda t: t.index, w(f"""SELECT clean_parent AS label, clean_parent AS value, 'PARENT' AS type, {money('total_spend')} AS score, NULL AS cage, NULL AS city, NULL AS state FROM s GROUP BY 1 HAVING COUNT(DISTINCT cage_code) > 1 OR {money('total_spend')} > 1e9
 UNION ALL SELECT g.*, geo.city, geo.state FROM (SELECT vendor_name AS label, cage_code AS value, 'CHILD' AS type, {money('total_spend')} AS score, cage_code AS cage FROM s GROUP BY 1, 2) g LEFT JOIN geo ON geo.cage_code = g.cage
 UNION ALL SELECT platform_family, platform_family, 'PLATFORM', {money('total_spend')}, NULL, NULL, NULL FROM s GROUP BY 1 UNION ALL SELECT sub_agency, sub_agency, 'AGENCY', {money('total_spend')}, NULL, NULL, NULL FROM s GROUP BY 1
 UNION ALL SELECT title, sol_num, 'OPPORTUNITY', 999999999.0::DOUBLE, NULL, NULL, NULL FROM opps""", TX, S, GEO, OPPS)),
        "search_global_merge": (lambda t: Q.search_global(t.index, "brand#1"), w(f"SELECT CAST(row_number() OVER (ORDER BY score DESC, key) AS INTEGER) AS place, key, type, label, label AS value, {_MONEY_LABEL} AS sub_label, NULL AS cage, score FROM (SELECT 'PLATFORM-' || platform_family AS key, platform_family AS label, 'PLATFORM' AS type, {money('total_spend')} AS score FROM s WHERE platform_family LIKE '%BRAND#1%' GROUP BY 2 ORDER BY score DESC, key LIMIT 8)", TX, S)),
        "vendor_typeahead": (lambda t: Q.vendor_typeahead(t.s, "0001"), w("SELECT cage_code, max(vendor_name) AS vendor_name, max(city) AS city FROM s WHERE vendor_name LIKE '%0001%' OR cage_code LIKE '%0001%' GROUP BY 1 ORDER BY 1 LIMIT 10", TX, S)),
        "taxonomy_typeahead": (lambda t: Q.taxonomy_typeahead(t.s, "naics", "00001"), w("SELECT naics_code AS code, max(naics_description) AS name FROM s WHERE naics_code LIKE '%00001%' OR upper(naics_description) LIKE '%00001%' GROUP BY 1 ORDER BY 1 LIMIT 15", TX, S)),
        # explorer
        "explorer_page": (lambda t: explorer.select(explorer.build("transactions", t.tx, {"sub_agency": AGENCY, "year": YEARS, "nothing": "x"}, min_spend=60000), ["contract_id", "sub_agency", "spend_amount", "part_number", "unknown"], "transactions").orderBy(F.desc("spend_amount"), "contract_id", "part_number").offset(5).limit(30), w(f"SELECT contract_id, sub_agency, spend_amount, part_number FROM tx WHERE sub_agency = '{AGENCY}' AND year IN {YEAR_LIST} AND spend_amount >= 60000 ORDER BY 3 DESC, 1, 4 LIMIT 30 OFFSET 5", TX)),
        "explorer_count": (lambda t: explorer.count(explorer.build("transactions", t.tx, {"vendor_cage": [CAGE, "00004"]})), w(f"SELECT count(*) AS n FROM tx WHERE vendor_cage IN ('{CAGE}', '00004')", TX)),
        "explorer_preview": (lambda t: explorer.preview(explorer.select(explorer.build("summary", t.s, {"clean_parent": PARENT}), table="summary"), [F.desc("total_spend"), F.col("vendor_name"), F.col("platform_family"), F.col("market_segment"), F.col("contract_count")]), w(f"SELECT vendor_name, cage_code, clean_parent, total_spend, contract_count, market_segment, platform_family FROM s WHERE clean_parent = '{PARENT}' ORDER BY total_spend DESC, vendor_name, platform_family, market_segment, contract_count LIMIT 50", TX, S)),
        "explorer_search_any": (lambda t: explorer.count(explorer.build("nsn_cage_reference", t.reference, q="P12")), w("SELECT count(*) AS n FROM listing WHERE upper(nsn || '|' || niin || '|' || cage || '|' || description || '|' || part_number) LIKE '%P12%'", TX, ROWS, LISTED)),
        # cleaning, reports
        "summary_clean_alias": (lambda t: M.summary_clean(t.dirty, t.raw("supplier").select(F.concat(F.lit("C"), F.col("s_suppkey")).alias("child_cage"), F.upper("s_name").alias("parent_name"))), """
SELECT c_custkey, vendor_name, cage_code, sub_agency, market_segment, platform_family, total_spend, coalesce(upper(s_name), vendor_name) AS clean_parent, vendor_name || ' ' || platform_family || ' ' || coalesce(cage_code, '') AS fast_search FROM (
 SELECT c_custkey, CASE WHEN c_custkey % 7 < 2 THEN 'THE BOEING COMPANY' ELSE upper(c_name) END AS vendor_name, CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE 'C' || c_custkey END AS cage_code,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_mktsegment) END AS sub_agency, CAST(NULL AS VARCHAR) AS market_segment, 'F-16' AS platform_family, c_acctbal AS total_spend FROM customer) LEFT JOIN supplier ON cage_code = 'C' || s_suppkey"""),
        "null_word_cleaning": (lambda t: t.dirty.select("c_custkey", N.cage_frame(F.col("cage_code")).alias("frame"), N.cage_sql(F.col("cage_code")).alias("padded"), N.null_words(F.col("sub_agency"), N.ETL_NULLS).alias("agency")), """
SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN '' WHEN length('C' || c_custkey) < 5 THEN lpad('C' || c_custkey, 5, '0') ELSE 'C' || c_custkey END AS frame, CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE lpad('C' || c_custkey, 5, '0') END AS padded,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_mktsegment) END AS agency FROM customer"""),
        "hitlist": (lambda t: M.hitlist(t.geo, t.s).select("cage_code", "vendor_name", "total_spend").limit(500), w(f"SELECT geo.cage_code, geo.vendor_name, coalesce({money('total_spend')}, 0) AS total_spend FROM geo LEFT JOIN s ON s.cage_code = geo.cage_code GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 500", TX, S, GEO)),
        "hitlist_lifetime": (lambda t: M.hitlist(t.geo, t.s).select("cage_code", "vendor_name", "total_spend"), w(f"SELECT geo.cage_code, geo.vendor_name, coalesce({money('total_spend')}, 0) AS total_spend FROM geo LEFT JOIN s ON s.cage_code = geo.cage_code GROUP BY 1, 2 ORDER BY 3 DESC, 2", TX, S, GEO)),
        "spend_tiers": (lambda t: M.spend_tiers(t.geo, t.s, ["ST_1", "ST_2"]), w(f"""SELECT tier, n, n * 100.0::DOUBLE / sum(n) OVER () AS pct_rows, value, value * 100.0::DOUBLE / CAST(sum(CAST(value AS DECIMAL(18,4))) OVER () AS DOUBLE) AS pct_value FROM (
 SELECT CASE WHEN spend > -1 AND spend <= 0 THEN 'Zero' WHEN spend > 0 AND spend <= 1e5 THEN '<100k' WHEN spend > 1e5 AND spend <= 1e6 THEN '100k-1M' WHEN spend > 1e6 AND spend <= 1e12 THEN '>1M' END AS tier, count(*) AS n, {money('spend')} AS value
 FROM (SELECT cage_code, {money('total_spend')} AS spend FROM s GROUP BY 1) JOIN geo USING (cage_code) WHERE state NOT IN ('ST_1', 'ST_2') GROUP BY 1)""", TX, S, GEO)),
        "whales_counts": (lambda t: M.whales(t.s, 5e4, 9e4), w("SELECT COUNT(DISTINCT CASE WHEN total_spend >= 50000 THEN cage_code END) AS over_low, COUNT(DISTINCT CASE WHEN total_spend >= 90000 THEN cage_code END) AS over_high FROM s", TX, S)),
        "naics_prefix_hydration": (lambda t: Q.naics_titles(t.profiles, t.titles), w("""SELECT cage_code, code, 'title ' || substr(code, 1, 5) AS title FROM (SELECT cage_code, regexp_extract(x, '^([0-9]+)', 1) AS code FROM (
 SELECT cage_code, unnest(list_sort(list(DISTINCT naics_code || ' - ' || naics_description))[1:5]) AS x FROM s WHERE cage_code <> '00000' GROUP BY 1))""", TX, S)),
        "events_hourly": (lambda t: incremental.windowed_totals(t.raw("events")), f"SELECT date_trunc('hour', ts) AS start, event_type, {money('value')} AS total, count(*) AS n FROM events GROUP BY 1, 2"),
        "topic_dedup": (lambda t: Q.topic_dedup(t.raw("conversations").select(F.col("conv_id").alias("feed"), F.col("turn").alias("pos"), F.col("text").alias("title"))), TOPICS),
    }


def entries() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    from . import catalogue_more

    return _entries() | catalogue_more.entries()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Tables(spark, sf_dir))) for name, (fn, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql}
