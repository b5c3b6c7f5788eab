import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tenderspark import catalogue
from tenderspark.operators import explorer
from tenderspark.operators.filters import Filters, after, domain_match, is_code, safe_int, safe_years, sanitize
from tenderspark.plans import marts as M
from tenderspark.plans import queries as Q
from tenderspark.sources import io
from tenderspark.streaming import incremental

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_parameters():
    assert safe_int("x", 5, 1, 9) == 5 and safe_int(99, 5, 1, 9) == 9
    assert safe_years(["2020", 2020, "20x", 1800, 2021]) == [2020, 2021]
    assert sanitize(" a';b--c ") == "ABC"
    assert [is_code(x) for x in ("334", "R425", "RADAR", "R42")] == [True, True, False, False]


def test_filters(spark):
    s = spark.createDataFrame([("50%_x inc", "P", "00001", 2e6, 2020, "1620", "gear"), ("50abx", "Q", "00002", 1.0, 2021, "9999", "GEAR box")], "vendor_name string, clean_parent string, cage_code string, total_spend double, year int, psc_code string, psc_description string")
    n = lambda **k: s.where(Filters(**k).column()).count()
    assert n(vendor="50%_X") == 1 and n(psc="gear") == 2 and n(threshold_m=1) == 2 and n(threshold_m=1.5) == 1 and n(threshold_m="x") == 2 and n(years=[2021], parent="q") == 1
    opps = spark.createDataFrame([("R425", "336", "radar", "x")], "psc string, naics string, title string, description string")
    assert opps.where(domain_match("R425")).count() == 1 and opps.where(domain_match("RADAR")).count() == 1 and opps.where(domain_match("334")).count() == 0


def test_keyset_pages_join_to_the_whole(spark):
    rows = [(float(i % 3), f"2020-01-0{i % 2 + 1}", f"{i:02d}", "v", "a") for i in range(30)]
    df = spark.createDataFrame(rows, "total_spend double, last_action_date string, contract_id string, vendor_name string, sub_agency string")
    out, seek = [], None
    while True:
        got = Q.award_search(df, filters=[F.lit(True)], seek=seek, limit=7).collect()
        out += [tuple(r)[:3] for r in got[:7]]
        if len(got) <= 7:
            break
        seek = out[-1]
    assert out == sorted([r[:3] for r in rows], reverse=True)
    assert df.where(after(Q.AWARD_ORDER, (2.0, "2020-01-02", "29"))).count() == 29


def test_distribution(spark):
    s = spark.createDataFrame([(x, v) for x, v in (("a", 50.0), ("b", 20.0), (None, 10.0), ("c", 8.0), ("d", 7.0), ("e", 5.0))], "label string, total_spend double").withColumn("year", F.lit(2020))
    got = {r.label: (r.value, r.pct) for r in Q.distribution(s, "label", Filters()).collect()}
    assert got == {"a": (50.0, 50.0), "b": (20.0, 20.0), "c": (8.0, 8.0), "d": (7.0, 7.0), "Other": (15.0, 15.0)}
    assert Q.distribution(s.limit(0), "label", Filters()).count() == 0


def test_pick_name_and_sources(spark):
    rows = spark.createDataFrame([("1", "A (2021)", 2020, 5.0), ("1", "B", 2021, 1.0), ("2", "X", 2020, 1.0), ("2", "Y", 2020, 2.0), ("3", "P", 2020, 1.0), ("3", "Q", 2020, 1.0)], "cage_code string, vendor_name string, year int, total_spend double")
    assert {r.cage_code: r.vendor_name for r in M.pick_name(rows).collect()} == {"1": "B", "2": "Y", "3": "Q"}
    s = rows.withColumns({"contract_count": F.lit(1), "naics_code": F.lit("1"), "naics_description": F.lit("x"), "platform_family": F.lit("p")})
    edges = spark.createDataFrame([("1", "N", "9", "M", "c", 2020, 3.0)], "prime_cage string, prime_name string, sub_cage string, sub_name string, contract_id string, year int, subaward_value double")
    assert {r.cage_code: r.profile_source for r in M.profiles(s, edges).collect()} == {"1": "AWARD_AND_NETWORK", "2": "AWARD_BACKED", "3": "AWARD_BACKED", "9": "NETWORK_ONLY"}


def test_search_index_parents(spark):
    base = [("P1", "1", 0.5e9), ("P2", "2", 5.0), ("P2", "3", 5.0), ("P3", "4", 2e9), ("P4", "5", -1.0), ("P4", "6", -1.0)]
    s = spark.createDataFrame([(p, f"v{c}", c, x, "f", "a") for p, c, x in base], "clean_parent string, vendor_name string, cage_code string, total_spend double, platform_family string, sub_agency string")
    geo = spark.createDataFrame([], "cage_code string, city string, state string")
    opps = spark.createDataFrame([], "title string, sol_num string")
    got = {r.label for r in M.search_index(s, geo, opps).where("type = 'PARENT'").collect()}
    assert got == {"P2", "P3"}


def many_vendors(spark, n=20_040):
    """A summary of n vendors, the first ones of least spend, each with a parent that has two cages, a platform and an agency."""
    k = F.col("id")
    pad = lambda c, m: F.lpad(c.cast("string"), m, "0")
    of = lambda name, m: F.concat(F.lit(name), (k % m).cast("string")).alias(name)
    s = spark.range(n).select(F.concat(F.lit("SUPPLIER#"), pad(k, 9)).alias("vendor_name"), pad(k, 5).alias("cage_code"), of("clean_parent", 5_005), of("platform_family", 2_003), of("sub_agency", 2_004), (1000.0 + k).alias("total_spend"))
    geo = s.select("cage_code", F.lit("C").alias("city"), F.lit("ST").alias("state"))
    return s, geo, spark.createDataFrame([], "title string, sol_num string")


def test_search_index_is_whole(spark):
    index = M.search_index(*many_vendors(spark))
    assert {r["type"]: r["count"] for r in index.groupBy("type").count().collect()} == {"CHILD": 20_040, "PARENT": 5_005, "PLATFORM": 2_003, "AGENCY": 2_004}


def test_search_finds_a_part_among_small_vendors(spark):
    got = Q.search_global(M.search_index(*many_vendors(spark)), "000000012").collect()
    assert [(r.place, r.type, r.label, r.cage) for r in got] == [(0, "NSN", "Lookup Part: 000000012", None), (1, "CHILD", "SUPPLIER#000000012", "00012")]


def test_search_merges_all_hits(spark):
    """A site of 150 names, each less than those of 100 other sites: its sum is the most."""
    rows = [(f"ACME {k}", "1", "CHILD", 10.0, "1", "C", "S") for k in range(150)] + [(f"ACME X{k}", f"x{k}", "CHILD", 100.0, f"x{k}", "C", "S") for k in range(100)]
    index = spark.createDataFrame(rows, "label string, value string, type string, score double, cage string, city string, state string")
    assert [(r.key, r.score) for r in Q.search_global(index, "acme", k=2).collect()] == [("site-1", 1500.0), ("site-X0", 100.0)]


def test_search_finds_sites_among_small_vendors(spark):
    got = Q.search_global(M.search_index(*many_vendors(spark)), "r#00000001").collect()
    assert [(r.place, r.key, r.score) for r in got] == [(p + 1, f"site-000{19 - p}", 1019.0 - p) for p in range(8)]


def test_open_deadlines(spark):
    rows = spark.createDataFrame([(x, "t", "a", "s", "d") for x in ("2020-01-01", "2021-06-01", "2022-01-01T10:00:00+02:00", "n/a", None)], "deadline string, title string, agency string, sol_num string, description string")
    assert {r.deadline for r in M.opportunities(rows, "2021-06-01").collect()} == {"2021-06-01", "2022-01-01T10:00:00+02:00"}


def test_explorer(spark):
    df = spark.createDataFrame([("00001", "X", 5.0, "5945014851472")], "vendor_cage string, sub_agency string, spend_amount double, nsn string")
    assert explorer.resolve(df, "cage") == "vendor_cage" and explorer.resolve(df, "zzz") is None
    assert explorer.build("transactions", df, {"cage": ["00001", "2"]}, min_spend=1).count() == 1
    assert explorer.build("transactions", df, {"nsn": "014851472"}).count() == 1
    assert explorer.select(df, ["cage", "unknown"]).columns == ["cage"]
    with pytest.raises(ValueError):
        explorer.build("transactions", df, {"unknown": "x"})
    with pytest.raises(ValueError):
        explorer.build("transactions", df, {"a;b": "x"})


def test_suppliers_fall_back(spark):
    lookup = spark.createDataFrame([], "niin string, cage string, vendor string, contract_id string, last_sold string, total_revenue double")
    reference = spark.createDataFrame([("000000001", "A"), ("000000001", "B")], "niin string, cage string")
    assert [r.cage for r in Q.nsn_suppliers(lookup, reference, "1").collect()] == ["A", "B"]
    sold = spark.createDataFrame([("000000001", "A", "v", "c", "2020", 1.0)], lookup.schema)
    assert [r.cage for r in Q.nsn_suppliers(sold, reference, "1").collect()] == ["A"]
    assert {(r.cage, r.source) for r in Q.supplier_union(sold, reference, "1").collect()} == {("A", "SALES"), ("B", "REFERENCE")}


def test_topics(spark):
    titles = ["Alpha wins", "Alpha again", "BETA and Gamma", "nothing here", "Gamma"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "feed int, pos int, title string")
    assert [r.title for r in Q.topic_dedup(df).orderBy("pos").collect()] == ["Alpha wins", "BETA and Gamma", "nothing here"]


def test_io(spark, tmp_path):
    df = spark.createDataFrame([(1, "1,234.5"), (2, "x")], "a int, b string")
    path = f"file://{tmp_path}/t"
    assert not io.is_fresh(spark, path) and io.or_empty(spark, path, "a int").count() == 0
    io.publish(df, path)
    io.publish(df.limit(1), path, single=True)
    assert io.parquet(spark, path).count() == 1 == io.row_count(spark, path)
    assert io.is_fresh(spark, path) and not io.is_fresh(spark, path, force=True) and not io.is_fresh(spark, path, now=4e9)
    assert io.publish_if_stale(lambda: df, path, spark) is False and io.publish_if_stale(lambda: df, path, spark, force=True)
    io.write_csv(df, f"{path}.csv")
    assert [r.b for r in io.csv(spark, f"{path}.csv", ["b"]).orderBy("a").collect()] == [1234.5, None]
    (tmp_path / "sam.txt").write_text("a|b|c\nx|y\n1|2|3\n")
    assert sorted(r.one for r in io.delimited(spark, f"file://{tmp_path}/sam.txt", ["one", "two", "three"]).collect()) == ["1", "a"]
    explorer.export(df, f"{path}.out", [F.col("a")])
    assert spark.read.option("header", True).csv(f"{path}.out").count() == 2


@needs_data
def test_streaming(spark, tmp_path):
    events = f"{tmp_path}/in"
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(events)
    incremental.run_available(spark, events, f"{tmp_path}/out", f"{tmp_path}/check")
    done = spark.read.parquet(f"{tmp_path}/out")
    whole = incremental.windowed_totals(spark.read.parquet(events))
    assert 0 < done.count() <= whole.count() and done.selectExpr("cast(start AS string)", "event_type", "n").exceptAll(whole.selectExpr("cast(start AS string)", "event_type", "n")).count() == 0


@needs_data
def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    t = catalogue.Tables(spark, DATA)
    assert "PushedFilters: [IsNotNull(l_" in plan(t.tx) and "BroadcastHashJoin" in plan(t.tx)
    assert "TakeOrderedAndProject" in plan(Q.top_vendors(t.s, Filters()))
    for name, fn in catalogue.queries().items():
        assert "Python" not in plan(fn(spark, DATA)), name


@needs_data
@pytest.mark.parametrize("name", ["top_vendors", "distributions_platform", "contracts_rolled", "award_search_keyset_next", "subcontracts_rollup", "profiles_full_outer", "nsn_trend_encode", "search_index", "explorer_page", "summary_clean_alias"])
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = catalogue.queries()[name](spark, DATA)
    want = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def agrees_with_sql(spark, name, sf):
    data = f"/root/testdata/{sf}"
    db = duckdb.connect()
    for f in os.listdir(data):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    got = catalogue.queries()[name](spark, data)
    want = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(names) == sorted(got.columns) and sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    return [dict(zip(names, r, strict=True)) for r in rows]


def test_profile_sides(spark):
    s = spark.createDataFrame([("1", "A", 2020, 5.0, 2), ("1", "A", 2019, 1.0, 1), ("2", "B", 2018, 7.0, 4)], "cage_code string, vendor_name string, year int, total_spend double, contract_count long").withColumns({"naics_code": F.lit("1"), "naics_description": F.lit("x"), "platform_family": F.lit("p")})
    edges = spark.createDataFrame([("1", "A", "9", "M", "c", 2021, 3.0), ("1", "A", "00000", "Z", "d", 2022, 4.0)], "prime_cage string, prime_name string, sub_cage string, sub_name string, contract_id string, year int, subaward_value double")
    got = {(r.cage_code, r.vendor_name, r.profile_source, r.total_lifetime_spend, r.total_contracts, r.last_active_year, r.network_flow_total, r.network_contract_count, r.network_last_active_year) for r in M.profiles(s, edges).collect()}
    assert got == {("1", "A", "AWARD_AND_NETWORK", 6.0, 3, 2020, 7.0, 2, 2022), ("2", "B", "AWARD_BACKED", 7.0, 4, 2018, 0.0, 0, None), ("9", "M", "NETWORK_ONLY", 0.0, 0, None, 3.0, 1, 2021)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_profiles_hold_all_suppliers(spark):
    got = agrees_with_sql(spark, "profiles", "sf0.01")
    sold = {r[0] for r in catalogue.Tables(spark, "/root/testdata/sf0.01").s.select("cage_code").distinct().collect()}
    assert max(sold) > "00060" and {r["cage_code"] for r in got if r["total_contracts"]} == sold


@needs_data
@pytest.mark.parametrize("name", ["hitlist_lifetime", "trend_yearly", "nsn_supplier_union"])
def test_all_years(spark, name):
    got = agrees_with_sql(spark, name, "sf0.001")
    tx = catalogue.Tables(spark, DATA).tx
    if name == "hitlist_lifetime":
        assert abs(sum(r["total_spend"] for r in got) - tx.agg(F.sum("spend_amount")).first()[0]) < 1
    if name == "trend_yearly":
        assert next(r["amount"] for r in got if r["year"] == 1998) > 0
    if name == "nsn_supplier_union":
        assert {r["cage"] for r in got if r["source"] == "SALES"} == {r[0] for r in tx.where(F.col("niin") == catalogue.NIIN).select("vendor_cage").collect()}


def test_zero_fill_gap_and_reference_only(spark):
    geo = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "cage_code string, vendor_name string")
    s = spark.createDataFrame([("1", 2018, 5.0), ("1", 2021, 1.0), ("2", 2021, 9.0)], "cage_code string, year int, total_spend double")
    assert [(r.cage_code, r.total_spend) for r in M.hitlist(geo, s).collect()] == [("2", 9.0), ("1", 6.0), ("3", 0.0)]
    assert sorted(tuple(r) for r in Q.trend_yearly(s, Filters()).select("year", "amount").collect()) == [(2018, 5.0), (2019, 0.0), (2020, 0.0), (2021, 10.0)]
    sold = spark.createDataFrame([("000000001", "A", 1.0), ("000000001", "A", 2.0)], "niin string, cage string, total_revenue double")
    listed = spark.createDataFrame([("000000001", "A"), ("000000001", "B")], "niin string, cage string")
    assert {(r.cage, r.revenue, r.source) for r in Q.supplier_union(sold, listed, "1").collect()} == {("A", 3.0, "SALES"), ("B", 0.0, "REFERENCE")}


def test_entry_without_the_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tenderspark.llm'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 70 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
