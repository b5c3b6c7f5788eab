"""Domain tables made from a star schema of orders, so that every query runs on plain test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import fiscal_year, money

AS_OF = "2001-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad(c: str, n: int):
    return F.lpad(F.col(c).cast("string"), n, "0")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order line: a contract action.  Dimensions join by key; the optimizer broadcasts those that are small."""
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyer = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("sub_agency"), F.col("r_name").alias("parent_agency"))
    seller = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.upper("s_name").alias("vendor_name"), _pad("s_suppkey", 5).alias("vendor_cage"), F.upper("n_name").alias("clean_parent"),
        F.concat(F.lit("CITY_"), F.col("s_nationkey")).alias("city"), F.upper("r_name").alias("state"), F.col("s_nationkey").alias("place"))
    part = t("part").select(
        "p_partkey", F.col("p_name").alias("description"), F.upper("p_brand").alias("platform_family"), F.upper("p_type").alias("market_segment"), _pad("p_size", 6).alias("naics_code"), _pad("p_size", 4).alias("psc"),
        _pad("p_partkey", 9).alias("niin"), F.concat((F.lit(1000) + F.col("p_size")).cast("string"), _pad("p_partkey", 9)).alias("nsn"), F.concat(F.lit("P"), F.col("p_partkey")).alias("part_number"))
    lines = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    day = F.to_date("l_shipdate")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("contract_id"), day.cast("string").alias("action_date"), "vendor_name", "vendor_cage", "clean_parent", "sub_agency", "parent_agency", "description",
        money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("spend_amount"), "naics_code", "psc", F.col("market_segment").alias("psc_description"), "platform_family", "market_segment",
        fiscal_year(day).alias("year"), F.month(day).alias("month"), "nsn", "niin", "part_number", "city", "state", "place", F.col("l_quantity").alias("units"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("pricing_type"), F.col("l_linestatus").alias("competition_type"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"))


#: With these a contract's lines are in one order.
TIE = ("action_date", "line_no", "supp", "part", "price")


def management_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalogue knows of each part, taken from the part's own columns."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        _pad("p_partkey", 9).alias("niin"), F.col("p_name").alias("item_name"), F.concat(F.lit("D"), size % 5).alias("demil_code"), (size % 3).cast("string").alias("shelf_life_code"),
        F.col("p_type").alias("mgmt_control_code"), F.when(size % 2 == 0, "EA").otherwise("PG").alias("unit_of_issue"), F.upper("p_brand").alias("source_of_supply"),
        F.col("p_retailprice").alias("govt_estimated_price"), F.substring("p_type", 1, 1).alias("acquisition_advice_code"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a supplier lists: each part stands with one supplier that may or may not have sold it."""
    suppliers = max(1, table(spark, sf_dir, "supplier").count())  # from the footers
    cage = F.lpad((F.col("p_partkey") * 7 % suppliers).cast("string"), 5, "0")
    return table(spark, sf_dir, "part").select(
        _pad("p_partkey", 9).alias("niin"), F.concat((F.lit(1000) + F.col("p_size")).cast("string"), _pad("p_partkey", 9)).alias("nsn"), cage.alias("cage"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("part_number"), F.col("p_name").alias("description"))


def vendor_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_nationkey").cast("double")
    return table(spark, sf_dir, "supplier").select(_pad("s_suppkey", 5).alias("cage_code"), F.upper("s_name").alias("vendor_name"), (key * 3.0 - 36).alias("latitude"), (key * 7.0 - 84).alias("longitude"), F.concat(F.lit("CITY_"), F.col("s_nationkey")).alias("city"), F.concat(F.lit("ST_"), F.col("s_nationkey")).alias("state"))


def solicitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders; their text is that of a document, dealt over all documents; the title is its first line."""
    documents = table(spark, sf_dir, "documents")
    docs = documents.select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("description"))
    key, n = F.col("o_orderkey"), max(1, documents.count())  # the count comes from the footers
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(docs, key % n == F.col("doc_id"), "left").select(
        key.cast("string").alias("id"), F.concat(F.when(key % 4 == 0, "SPE-").otherwise("SOL-"), key).alias("sol_num"), "title", F.col("c_mktsegment").alias("agency"), F.date_add(F.to_date("o_orderdate"), 60).cast("string").alias("deadline"),
        F.col("o_orderpriority").alias("set_aside_type"), F.lpad((key % 50 + 1).cast("string"), 6, "0").alias("naics"), F.lpad((key % 50 + 1).cast("string"), 4, "0").alias("psc"), "description",
        F.when(key % 10 == 0, "DLA").when(key % 2 == 0, "DIBBS").otherwise("SAM").alias("source_system"), F.concat(F.lit("ST_"), key % 7).alias("state"))
