"""Keys, null words, trends and labels as column expressions; no Python UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Words that stand for null, by place of use.  They differ on purpose.
CAGE_NULLS = ("NAN", "NONE", "NULL", "")
CATEGORY_NULLS = ("NAN", "NAN.0", "NONE", "", "UNKNOWN")
ETL_NULLS = ("NAN", "NONE", "UNKNOWN", "")
PROFILE_CAGE_NULLS = ("", "00000", "UNKNO", "UNKNOWN", "NONE", "NULL", "NAN")
TEXT_NULLS = ("NAN", "NONE", "")
OPTIONAL_NULLS = ("", "NAN", "NONE", "NULL", "NAT")
# Names of one vendor, and the one they become.
VENDOR_ALIASES, VENDOR_NAME = ("THE BOEING", "BOEING", "BOEING CO"), "THE BOEING COMPANY"
# Endings that company names lose, one after the other, each once.
COMPANY_ENDINGS = (" CORPORATION", " COMPANY", " INC.", " INC", " LLC", " CORP.", " CORP", " LTD.", " LTD", ",")
# Design and standards authorities by cage.
AUTHORITIES = {
    "19207": "US ARMY TACOM - DESIGN ACTIVITY",
    "81349": "MILITARY STANDARDS / PROMULGATING ACTIVITY",
    "80205": "NATIONAL AEROSPACE STANDARDS (NAS)",
    "96906": "MILITARY STANDARDS (MS)",
    "57685": "NAVAL AIR SYSTEMS COMMAND",
    "81348": "FEDERAL SPECIFICATIONS",
    "88044": "AERONAUTICAL STANDARDS GROUP",
    "9009H": "WSK PZL-KALISZ S.A. (POLAND)",
    "100CB": "ARITEX CADING S.A. (SPAIN)",
    "A486G": "PATRIA AVIATION OY (FINLAND)",
    "K1037": "HANWHA AEROSPACE (SOUTH KOREA)",
    "D0019": "RHEINMETALL LANDSYSTEME (GERMANY)",
}
# Shapes of a stock number or an item number, as typed.
PART_SHAPE = r"^\d{4}-?\d{2}-?\d{3}-?\d{4}$|^\d{9}$|^\d{13}$"


def strip(c: Column) -> Column:
    """Trim all white space (SQL's trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def null_words(c: Column, words: Sequence[str]) -> Column:
    """Upper-cased and trimmed; null where a null word is left."""
    u = F.upper(F.trim(c))
    return F.when(~u.isin(*words), u)


def optional(c: Column) -> Column:
    """Trimmed; null where nothing but a word for null is left."""
    t = F.trim(c)
    return F.when(~F.upper(t).isin(*OPTIONAL_NULLS), t)


def without_nan_words(c: Column) -> Column:
    """A list in a string without its NAN entries, and without commas at either end."""
    for pattern in (r"\bNAN\b,?", ",+$", "^,+"):
        c = F.regexp_replace(c, pattern, "")
    return c


def company(c: Column) -> Column:
    """Upper-cased, without the endings of legal forms.

    A fold over an array: a chain of expressions would hold the name four times as often with each ending."""
    ends = F.array(*[F.lit(end) for end in COMPANY_ENDINGS])
    return F.trim(F.aggregate(ends, F.upper(c), lambda x, end: F.when(F.endswith(x, end), F.left(x, F.length(x) - F.length(end))).otherwise(x)))


def code_of(label: Column) -> Column:
    """`1620 - GEAR` -> `1620`."""
    return F.trim(F.split_part(label, F.lit(" - "), F.lit(1)))


def unescaped(c: Column) -> Column:
    """The five named entities of XML, and numbered quotes; ampersands last, so that nothing is read twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def half_even(c: Column) -> Column:
    """Double to int as SQL engines that round to even do (a plain cast cuts)."""
    return F.bround(c, 0).cast("int")


def vendor_label(name: Column, cage: Column, known: Column) -> Column:
    """The name if there is one, else the authority's, else the one known by cage, else one made of the cage."""
    own = F.when(~F.upper(F.trim(name)).isin(*TEXT_NULLS), name)
    named = F.lit(None).cast("string")
    for code, authority in AUTHORITIES.items():
        named = F.when(cage == code, F.lit(authority)).otherwise(named)
    return F.coalesce(own, named, F.nullif(known, F.lit("")), F.concat(F.lit("Unknown Manufacturer (CAGE: "), cage, F.lit(")")))


def cage_frame(c: Column) -> Column:
    """'' for null and 'nan'; 1 to 4 characters are padded to 5; longer ones stay."""
    u = F.upper(strip(F.coalesce(c, F.lit(""))))
    u = F.when(u == "NAN", F.lit("")).otherwise(u)
    return F.when(F.length(u).between(1, 4), F.lpad(u, 5, "0")).otherwise(u)


def cage_sql(c: Column) -> Column:
    """Letters and digits, padded or cut to 5; null words are told before the padding."""
    u = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    return F.when(~u.isin(*PROFILE_CAGE_NULLS), F.lpad(u, 5, "0"))


def naics(c: Column) -> Column:
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\.0$", "")
    return F.when(F.lower(s).isin("nan", "none"), F.lit("")).otherwise(s)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def niin_input(c: Column) -> Column:
    """What a user types: digits, padded to 9, or the last 9."""
    d = digits(F.coalesce(c, F.lit("")))
    return F.when(F.length(d) < 9, F.lpad(d, 9, "0")).otherwise(F.right(d, F.lit(9)))


def niin_of_nsn(c: Column) -> Column:
    """Last 9 digits; null when there are fewer."""
    d = digits(c)
    return F.when(F.length(d) >= 9, F.right(d, F.lit(9)))


def niin_catalogue(c: Column) -> Column:
    return F.lpad(c.cast("string"), 9, "0")


def fsc(nsn: Column) -> Column:
    return F.substring(digits(nsn), 1, 4)


def vendor(c: Column) -> Column:
    u = F.upper(F.trim(c))
    return F.when(u.isin(*VENDOR_ALIASES), F.lit(VENDOR_NAME)).otherwise(u)


def no_year_suffix(c: Column) -> Column:
    # Fixed value: the ending that tells a year.
    return F.regexp_replace(c, r"\s*\(\d{4}\)\s*$", "")


def fiscal_year(date: Column) -> Column:
    return F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)


def fiscal_order(month: Column) -> Column:
    """October is 1, September 12; a null month counts as January."""
    m = F.coalesce(month, F.lit(1))
    return F.when(m >= 10, m - 9).otherwise(m + 3)


def title_case(c: Column) -> Column:
    """A capital after anything that is not a letter (initcap: after white space only)."""
    parts = F.split(F.lower(c), "(?<=[^a-z])|(?=[^a-z])")
    return F.array_join(F.transform(parts, F.initcap), "")


def after_bang(c: Column) -> Column:
    """All after the first '!'; the whole text without one."""
    at = F.instr(c, "!")
    return F.when(at > 0, c.substr(at + 1, F.length(c))).otherwise(c)


def json_safe(c: Column) -> Column:
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def money(c: Column) -> Column:
    """Exact within sums, whatever the order of rows."""
    return c.cast("decimal(18,4)")


def total(c: Column) -> Column:
    return F.sum(money(c)).cast("double")


def weighted_price(price: Column, units: Column) -> Column:
    """By units; without units the mean of prices that are not 0."""
    u = F.sum(F.coalesce(units, F.lit(0.0)).cast("decimal(18,4)")).cast("double")
    pu = F.sum((price * units).cast("decimal(24,4)")).cast("double")
    return F.when(u > 0, pu / u).otherwise(F.avg(F.nullif(price, F.lit(0.0))))


def money_label(c: Column) -> Column:
    return (
        F.when(c >= 1e9, F.format_string("$%.1fB", c / 1e9))
        .when(c >= 1e6, F.format_string("$%.1fM", c / 1e6))
        .when(c >= 1e3, F.format_string("$%.1fK", c / 1e3))
        .otherwise(F.format_string("$%.0f", c))
    )


def short_money(c: Column) -> Column:
    """Billions and millions with a digit, else whole thousands; '' for nothing."""
    big = F.when(c >= 1e9, F.format_string("$%,.1fB", c / 1e9)).when(c >= 1e6, F.format_string("$%,.1fM", c / 1e6))
    return F.when(c > 0, big.otherwise(F.format_string("$%,.0fK", c / 1e3))).otherwise(F.lit(""))


def millions(c: Column) -> Column:
    return F.format_string("$%.1fM", c / 1e6)


def spend_tier(c: Column) -> Column:
    """Right-closed: (-1, 0], (0, 1e5], (1e5, 1e6], (1e6, 1e12]; null outside."""
    return (
        F.when((c > -1) & (c <= 0), "Zero").when((c > 0) & (c <= 1e5), "<100k")
        .when((c > 1e5) & (c <= 1e6), "100k-1M").when((c > 1e6) & (c <= 1e12), ">1M")
    )


def top_list(values: Column, k: int = 5, sep: str = ", ") -> Column:
    """The first k distinct values in order, joined."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(values)), 1, k), sep)


def top_lists(df, key: str, values: dict[str, Column], k: int = 5, sep: str = ", "):
    """For each key the first k distinct values of each expression, joined.

    Distinct before they are ranked, and at most k of a key's values leave a partition, so no key is ever gathered whole."""
    out = df.select(key).distinct()
    order = Window.partitionBy(key).orderBy("v")
    for name, value in values.items():
        first = df.select(key, value.alias("v")).where("v IS NOT NULL").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
        lists = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "v"))), lambda s: s["v"]), sep).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


# -- trends: 'year:amount|year:amount' -------------------------------------------------------------------------------


def trend_sum(trend: Column, years: Sequence[int]) -> Column:
    """Sum over `years`; segments without a colon are passed over, the first bad one ends the sum."""
    empty = F.struct(F.lit(0.0).alias("s"), F.lit(True).alias("go"))

    def step(acc: Column, seg: Column) -> Column:
        parts = F.split(seg, ":")
        year = F.trim(parts[0]).try_cast("int")
        amount = F.trim(parts[1]).try_cast("double")
        wanted = year.isin(*[int(y) for y in years])
        bad = (F.size(parts) != 2) | year.isNull() | (wanted & amount.isNull())
        go = acc["go"] & ~F.coalesce(bad, F.lit(True))
        return F.struct((acc["s"] + F.when(go & wanted, amount).otherwise(0.0)).alias("s"), go.alias("go"))

    segs = F.filter(F.split(F.coalesce(trend, F.lit("")), "[|]"), lambda x: x.contains(":"))
    return F.aggregate(segs, empty, step, lambda acc: acc["s"]) if years else F.lit(0.0)


def trend_entries(trend: Column) -> Column:
    """Array of (year, amount); bad segments are skipped, each for itself."""
    segs = F.filter(F.split(F.coalesce(trend, F.lit("")), "[|]"), lambda x: x.contains(":"))
    made = F.transform(segs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).try_cast("int").alias("year"), F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))).try_cast("double").alias("amount")))
    return F.filter(made, lambda e: e["year"].isNotNull() & e["amount"].isNotNull())


def trend_map(trend: Column) -> Column:
    """Map of the same; a later segment of the same year overwrites."""
    none = F.create_map().cast("map<int,double>")
    put = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["year"]), F.map_from_arrays(F.array(e["year"]), F.array(e["amount"])))
    return F.aggregate(trend_entries(trend), none, put)


def trend_text(years: Column, amounts: Column) -> Column:
    """Aggregate: one row a year -> text in order of years, amounts with two decimals."""
    entry = F.concat(years.cast("string"), F.lit(":"), amounts.cast("decimal(20,2)").cast("string"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(years.alias("y"), entry.alias("e")))), lambda s: s["e"]), "|")


def filled_years(df, years: str = "year", amount: str = "amount"):
    """Rows for the years between the least and the greatest that have none, with 0."""
    span = df.agg(F.min(years).alias("a"), F.max(years).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias(years))
    return span.join(df, years, "left").select(years, F.coalesce(amount, F.lit(0.0)).alias(amount))
