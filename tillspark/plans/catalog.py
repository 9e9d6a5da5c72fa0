"""Every operator as a query over the provided tables, with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..functions.calendar import semester, time_parts, year_month
from ..functions.ids import short_id
from ..functions.parsing import split_first, to_timestamp
from ..operators import aggregates, cleaners, filters, joins, ranking
from ..shared import fresh_path
from ..sources import adapters, messages
from ..sources.buckets import bucketed_lookup, write_side
from ..sources.calendar_table import of_months, read_calendar, write_calendar
from ..sources.files import ORDER, scan_parquet, stream_parquet
from ..sources.ingest import ingest
from ..sources.sinks import as_lines, from_semester_json, semester_json
from ..streaming import jobs
from ..streaming.ends import end_marks
from ..streaming.state import state_session
from ..streaming.text import land, landed
from . import questions

#: Two years that the tables cover; orders and lines have dates alone, so all hours.
YEARS = Params(from_year=1996, to_year=1997, from_hour=0, to_hour=23)
EVENTS = Params()

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# The roles of the tables in SQL.
EVENT_TX = "SELECT CAST(event_id AS VARCHAR) AS transaction_id, event_type AS store_id, CAST(user_id AS VARCHAR) AS user_id, value AS final_amount, ts AS created_at FROM events"
ORDER_TX = "SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(c_nationkey AS VARCHAR) AS store_id, CAST(o_custkey AS VARCHAR) AS user_id, o_totalprice AS final_amount, o_orderdate AS created_at, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey"
LINE_TX = "SELECT CAST(l_suppkey AS VARCHAR) AS store_id, CAST(o_custkey AS VARCHAR) AS user_id, l_extendedprice AS final_amount, l_shipdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
ITEMS = "SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS subtotal, l_shipdate AS created_at FROM lineitem"
YEARS_SQL = "created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1998-01-01'"
EVENT_YEARS = "created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2026-01-01'"
HOURS = "hour(created_at) BETWEEN 6 AND 23 AND NOT (hour(created_at) = 23 AND minute(created_at) > 0 AND second(created_at) > 0)"
STRICT = "hour(created_at) BETWEEN 6 AND 23 AND NOT (hour(created_at) = 23 AND (minute(created_at) > 0 OR second(created_at) > 0))"
MONTH = "strftime(created_at, '%Y-%m')"
SEMESTER = "strftime(created_at, '%Y') || CASE WHEN month(created_at) <= 6 THEN '-H1' ELSE '-H2' END"
GROUPS = f"SELECT {MONTH} AS year_month, item_id, CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(CAST(subtotal AS DECIMAL(18,2))) AS DOUBLE) AS total_profit FROM ({ITEMS}) WHERE {YEARS_SQL} GROUP BY 1, 2"
BEST = f"SELECT year_month, item_id, total_quantity, CAST(0 AS DOUBLE) AS total_profit FROM (SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY total_quantity DESC, CAST(item_id AS BIGINT)) AS r FROM ({GROUPS})) WHERE r = 1"
EARN = f"SELECT year_month, item_id, CAST(0 AS BIGINT) AS total_quantity, total_profit FROM (SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY total_profit DESC, CAST(item_id AS BIGINT)) AS r FROM ({GROUPS})) WHERE r = 1"
TOTALS = f"SELECT {SEMESTER} AS semester, store_id, CAST(sum(CAST(final_amount AS DECIMAL(18,2))) AS DOUBLE) AS tpv FROM ({ORDER_TX}) WHERE {YEARS_SQL} GROUP BY 1, 2"
COUNTS = f"SELECT store_id, user_id, count(*) AS purchases FROM ({LINE_TX}) WHERE {YEARS_SQL} GROUP BY 1, 2"
LINE_TOTALS = f"SELECT {SEMESTER} AS semester, store_id, CAST(sum(CAST(final_amount AS DECIMAL(18,2))) AS DOUBLE) AS tpv FROM ({LINE_TX}) WHERE {YEARS_SQL} GROUP BY 1, 2"
EVENT_TOTALS = f"SELECT {SEMESTER} AS semester, store_id, '' AS user_id, CAST(sum(CAST(final_amount AS DECIMAL(28,10))) AS DOUBLE) AS tpv FROM ({EVENT_TX}) WHERE {EVENT_YEARS} AND {HOURS} GROUP BY 1, 2"
TOP = f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY store_id ORDER BY purchases DESC, CAST(user_id AS BIGINT)) AS INTEGER) AS rank FROM ({COUNTS})) WHERE rank <= 3"


def _named(rows: str) -> str:
    return f"SELECT year_month, p_name AS item_name, total_quantity, total_profit FROM ({rows}) JOIN part ON CAST(p_partkey AS VARCHAR) = item_id"


# Cleaning: the tables as raw lines, and back.
def _lines(df: DataFrame, *fields: object) -> DataFrame:
    parts = [F.lit("") if f is None else F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return df.select(F.concat_ws(",", *parts).alias("value"))


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


@query("SELECT CAST(event_id AS VARCHAR) AS transaction_id, event_type AS store_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id, value AS final_amount, date_trunc('second', ts) AS created_at FROM events")
def clean_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("user_id") % 7 != 0, F.concat(F.col("user_id").cast("string"), F.lit(".0")))
    events = scan_parquet(spark, sf_dir, "events")
    return cleaners.clean(_lines(events, F.col("event_id"), F.col("event_type"), None, None, user, F.col("value"), None, F.col("value"), _stamp("ts")), "transactions")


@query("SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS subtotal, l_shipdate AS created_at FROM lineitem")
def clean_transaction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan_parquet(spark, sf_dir, "lineitem")
    return cleaners.clean(_lines(lines, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("bigint"), None, F.col("l_extendedprice"), _stamp("l_shipdate")), "transaction_items")


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name FROM part")
def clean_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaners.clean(_lines(scan_parquet(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_retailprice")), "menu")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name FROM supplier")
def clean_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaners.clean(_lines(scan_parquet(spark, sf_dir, "supplier"), F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")), "store")


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS birthdate FROM customer")
def clean_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaners.clean(_lines(scan_parquet(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name"), None), "users")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name FROM supplier WHERE s_suppkey % 3 <> 0")
def clean_dropping_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = scan_parquet(spark, sf_dir, "supplier")
    short = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey"))
    return cleaners.clean(suppliers.select(short.alias("value")), "store", "drop")


# Filters.
@query(f"SELECT transaction_id, store_id, user_id, final_amount, created_at FROM ({ORDER_TX}) WHERE {YEARS_SQL}")
def filter_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filter(adapters.order_transactions(spark, sf_dir), "year", YEARS)


@query(f"SELECT * FROM ({EVENT_TX}) WHERE {HOURS}")
def filter_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filter(adapters.event_transactions(spark, sf_dir), "hour", EVENTS)


@query(f"SELECT * FROM ({EVENT_TX}) WHERE {STRICT}")
def filter_hour_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filter(adapters.event_transactions(spark, sf_dir), "hour", Params(hour_mode="strict"))


@query(f"SELECT * FROM ({EVENT_TX}) WHERE final_amount >= 75")
def filter_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filter(adapters.event_transactions(spark, sf_dir), "amount", EVENTS)


@query(f"SELECT transaction_id, store_id, nullif(CAST(CAST(user_id AS BIGINT) % 5 AS VARCHAR), '0') AS user_id, final_amount, created_at FROM ({EVENT_TX}) WHERE CAST(user_id AS BIGINT) % 5 <> 0")
def filter_known_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.nullif((F.col("user_id").cast("bigint") % 5).cast("string"), F.lit("0"))
    return filters.apply_filter(adapters.event_transactions(spark, sf_dir).withColumn("user_id", fifth), "user", EVENTS)


# Buckets and time parts.
@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders")
def bucket_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_parquet(spark, sf_dir, "orders").select("o_orderkey", year_month(F.col("o_orderdate")).alias("year_month"))


@query(f"SELECT o_orderkey, {SEMESTER.replace('created_at', 'o_orderdate')} AS semester FROM orders")
def bucket_semester(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_parquet(spark, sf_dir, "orders").select("o_orderkey", semester(F.col("o_orderdate")).alias("semester"))


@query('SELECT event_id, CAST(year(ts) AS INTEGER) AS "year", CAST(hour(ts) AS INTEGER) AS "hour", CAST(minute(ts) AS INTEGER) AS "minute", CAST(second(ts) AS INTEGER) AS "second" FROM events')
def time_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_parquet(spark, sf_dir, "events").select("event_id", *time_parts(F.col("ts")))


# Aggregations.
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(filters.filter_year(adapters.line_items(spark, sf_dir), 1996, 1997), "yearmonth")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(filters.filter_year(adapters.line_transactions(spark, sf_dir), 1996, 1997), "store")


@query(GROUPS)
def group_yearmonth_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


@query(TOTALS)
def group_semester_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(filters.filter_year(adapters.order_transactions(spark, sf_dir), 1996, 1997), "semester")


@query(COUNTS)
def group_store_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"SELECT o_orderpriority AS client_id, {SEMESTER} AS semester, store_id, CAST(sum(CAST(final_amount AS DECIMAL(18,2))) AS DOUBLE) AS tpv FROM ({ORDER_TX}) GROUP BY 1, 2, 3")
def group_semester_store_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.order_transactions(spark, sf_dir, "o_orderpriority").withColumnRenamed("o_orderpriority", "client_id")
    return aggregates.aggregate(rows, "semester", "client_id")


#: Amounts of less than a cent, and some above 1e18, in binary fractions: sums of either kind are exact.
ODD_TX = "SELECT event_type || CASE WHEN user_id % 7 = 0 THEN '-large' ELSE '' END AS store_id, CASE WHEN user_id % 7 = 0 THEN 1152921504606846976.0 ELSE (event_id % 1000) / 1024.0 END AS final_amount, ts AS created_at FROM events"


@query(f"SELECT {SEMESTER} AS semester, store_id, sum(CAST(final_amount AS DOUBLE)) AS tpv FROM ({ODD_TX}) GROUP BY 1, 2")
def group_small_and_large_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.col("user_id") % 7 == 0
    store = F.concat("event_type", F.when(large, "-large").otherwise(""))
    amount = F.when(large, F.lit(2.0**60)).otherwise((F.col("event_id") % 1000) / F.lit(1024.0))
    return aggregates.semester_stores(scan_parquet(spark, sf_dir, "events").select(store.alias("store_id"), amount.alias("final_amount"), F.col("ts").alias("created_at")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) END AS created_at FROM events")
def timestamps_need_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date or a year alone is no timestamp."""
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, _stamp("ts")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy"))
    return scan_parquet(spark, sf_dir, "events").select("event_id", to_timestamp(text).alias("created_at"))


@query(TOTALS.replace(f" WHERE {YEARS_SQL}", ""))
def merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.order_transactions(spark, sf_dir)
    odd = F.col("transaction_id").cast("bigint") % 2 == 1
    parts = [aggregates.semester_stores(rows.where(odd)), aggregates.semester_stores(rows.where(~odd))]
    return aggregates.merged(parts, ["semester", "store_id"], ["tpv"])


CLIENT_TOTALS = _SQL["group_semester_store_per_client"]


@query(f"SELECT client_id, store_id, string_agg(semester || '=' || printf('%.6f', tpv), ';' ORDER BY semester) AS dump FROM ({CLIENT_TOTALS}) GROUP BY 1, 2")
def dump_store_maps_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = aggregates.as_maps(group_semester_store_per_client(spark, sf_dir), ["client_id", "store_id"], "semester", "tpv")
    entry = F.transform(F.map_entries("entries"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.6f", e["value"])))
    return maps.select("client_id", "store_id", F.array_join(entry, ";").alias("dump"))


# Ranking.
@query(BEST)
def best_seller_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_sellers(_groups(spark, sf_dir))


@query(EARN)
def top_profit_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_earners(_groups(spark, sf_dir))


CLIENT_ITEMS = f"SELECT l_returnflag AS client_id, {MONTH} AS year_month, item_id, sum(quantity) AS n FROM (SELECT l_returnflag, CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_quantity AS BIGINT) AS quantity, l_shipdate AS created_at FROM lineitem) WHERE {YEARS_SQL} GROUP BY 1, 2, 3"


@query(f"SELECT client_id, year_month, item_id, CAST(n AS BIGINT) AS total_quantity, CAST(0 AS DOUBLE) AS total_profit FROM (SELECT *, row_number() OVER (PARTITION BY client_id, year_month ORDER BY n DESC, CAST(item_id AS BIGINT)) AS r FROM ({CLIENT_ITEMS})) WHERE r = 1")
def best_seller_per_month_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.as_items(scan_parquet(spark, sf_dir, "lineitem"), F.col("l_returnflag").alias("client_id"))
    return ranking.best_sellers(aggregates.month_items(filters.filter_year(lines, 1996, 1997), "client_id"), "client_id")


@query(f"SELECT client_id, year_month, CAST(item_id AS BIGINT) AS item_id, total_quantity, total_profit FROM (SELECT client_id, year_month, item_id, CAST(n AS BIGINT) AS total_quantity, CAST(0 AS DOUBLE) AS total_profit, row_number() OVER (PARTITION BY client_id, year_month ORDER BY n DESC, CAST(item_id AS BIGINT)) AS r FROM ({CLIENT_ITEMS})) WHERE r = 1 UNION ALL SELECT client_id, year_month, CAST(item_id AS BIGINT), 0, profit FROM (SELECT *, row_number() OVER (PARTITION BY client_id, year_month ORDER BY profit DESC, CAST(item_id AS BIGINT)) AS r FROM (SELECT l_returnflag AS client_id, {MONTH} AS year_month, item_id, CAST(sum(CAST(subtotal AS DECIMAL(18,2))) AS DOUBLE) AS profit FROM (SELECT l_returnflag, CAST(l_partkey AS VARCHAR) AS item_id, l_extendedprice AS subtotal, l_shipdate AS created_at FROM lineitem) WHERE {YEARS_SQL} GROUP BY 1, 2, 3)) WHERE r = 1")
def month_winners_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both maxima of each client's months in one pass of hash aggregates."""
    lines = adapters.as_items(scan_parquet(spark, sf_dir, "lineitem"), F.col("l_returnflag").alias("client_id")).withColumn("item_id", F.col("item_id").cast("bigint"))
    return ranking.month_winners(aggregates.month_items(filters.filter_year(lines, 1996, 1997), "client_id"), "client_id")


CLIENT_PROFITS = f"SELECT l_returnflag AS client_id, {MONTH} AS year_month, item_id, CAST(sum(CAST(subtotal AS DECIMAL(18,2))) AS DOUBLE) AS profit FROM (SELECT l_returnflag, CAST(l_partkey AS VARCHAR) AS item_id, l_extendedprice AS subtotal, l_shipdate AS created_at FROM lineitem) WHERE {YEARS_SQL} GROUP BY 1, 2, 3"


@query(f"SELECT client_id, year_month, item_id, CAST(0 AS BIGINT) AS total_quantity, profit AS total_profit FROM (SELECT *, row_number() OVER (PARTITION BY client_id, year_month ORDER BY profit DESC, CAST(item_id AS BIGINT)) AS r FROM ({CLIENT_PROFITS})) WHERE r = 1")
def top_profit_per_month_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapters.as_items(scan_parquet(spark, sf_dir, "lineitem"), F.col("l_returnflag").alias("client_id"))
    return ranking.top_earners(aggregates.month_items(filters.filter_year(lines, 1996, 1997), "client_id"), "client_id")


@query(TOP)
def topk_users_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_buyers(_counts(spark, sf_dir), 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def topk_amounts_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest amounts: a bounded heap per task."""
    return scan_parquet(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(5)


# Joins.
@query(f"SELECT p_name AS item_name, CAST(quantity AS BIGINT) AS quantity, created_at FROM ({ITEMS}) JOIN part ON CAST(p_partkey AS VARCHAR) = item_id AND p_partkey % 7 <> 0")
def join_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    menu = adapters.part_menu(spark, sf_dir).where(F.col("item_id").cast("bigint") % 7 != 0)
    return joins.lookup(adapters.line_items(spark, sf_dir).select("item_id", "quantity", "created_at"), menu, "items")


@query(f"SELECT s_name AS store_name, user_id, purchases FROM ({COUNTS}) JOIN supplier ON CAST(s_suppkey AS VARCHAR) = store_id")
def join_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.lookup(_counts(spark, sf_dir), adapters.supplier_stores(spark, sf_dir), "store")


@query(f"SELECT store_id, coalesce(c_name, user_id) AS birthdate, rank FROM ({TOP}) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id AND c_custkey % 7 <> 0")
def join_users_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = adapters.customer_users(spark, sf_dir).where(F.col("user_id").cast("bigint") % 7 != 0)
    return joins.lookup(ranking.top_buyers(_counts(spark, sf_dir), 3).select("store_id", "user_id", "rank"), users, "users")


@query("SELECT n_name AS store_name, count(*) AS n FROM (SELECT n_regionkey, max_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1) JOIN customer ON c_nationkey % 5 = n_regionkey GROUP BY 1")
def join_dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several names per id: the one that comes last is used, and no row is doubled."""
    side = scan_parquet(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("store_id"), F.col("n_name").alias("store_name"), "n_nationkey")
    left = scan_parquet(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("store_id"))
    return joins.name_lookup(left, side, "store_id", "store_name", "n_nationkey").groupBy("store_name").agg(F.count("*").alias("n"))


@query(f"{BEST} UNION ALL {EARN}")
def union_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    return ranking.best_sellers(groups).unionByName(ranking.top_earners(groups))


# The questions.
@query(f"SELECT * FROM ({EVENT_TX}) WHERE {EVENT_YEARS} AND {HOURS} AND final_amount >= 75")
def q1_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.large_transactions(adapters.event_transactions(spark, sf_dir), EVENTS)


@query(_named(f"{BEST} UNION ALL {EARN}"))
def q2_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.numbered_items(scan_parquet(spark, sf_dir, "lineitem"))
    return questions.month_products(items, adapters.part_menu(spark, sf_dir), YEARS)


@query(f"SELECT year_month, item_name, total_quantity FROM ({_named(BEST)})")
def q2_best_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.month_best_sellers(adapters.line_items(spark, sf_dir), adapters.part_menu(spark, sf_dir), YEARS)


@query(f"SELECT year_month, item_name, total_profit FROM ({_named(EARN)})")
def q2_top_earners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.month_top_earners(adapters.line_items(spark, sf_dir), adapters.part_menu(spark, sf_dir), YEARS)


@query(TOTALS)
def q3_tpv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.semester_totals(adapters.order_transactions(spark, sf_dir), YEARS)


Q4 = f"SELECT s_name AS store_name, coalesce(c_name, user_id) AS birthdate, rank FROM ({TOP}) JOIN supplier ON CAST(s_suppkey AS VARCHAR) = store_id LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id"


@query(Q4)
def q4_top_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.buyers_birthdays(adapters.line_transactions(spark, sf_dir), adapters.supplier_stores(spark, sf_dir), adapters.customer_users(spark, sf_dir), YEARS)


@query(f"SELECT CAST(3 AS INTEGER) AS question, semester, store_id, CAST(NULL AS VARCHAR) AS user_id, tpv, CAST(NULL AS BIGINT) AS purchases FROM ({LINE_TOTALS}) UNION ALL SELECT 4, NULL, store_id, user_id, NULL, purchases FROM ({COUNTS})")
def fan_out_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of questions 3 and 4 from one pass over the transactions."""
    return questions.fan_out(adapters.line_transactions(spark, sf_dir), YEARS)


@query(f"{EVENT_TOTALS} UNION ALL SELECT '4', store_id, user_id, CAST(count(*) AS DOUBLE) FROM ({EVENT_TX}) WHERE {EVENT_YEARS} GROUP BY 2, 3")
def fan_out_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With hours, which bear on question 3 alone."""
    fan = questions.fan_out(adapters.event_transactions(spark, sf_dir), EVENTS)
    counts = fan.where("question = 4").select(F.lit("4").alias("semester"), "store_id", "user_id", F.col("purchases").cast("double").alias("tpv"))
    return questions.totals_of(fan).withColumn("user_id", F.lit("")).unionByName(counts)


@query(Q4)
def fan_out_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    fan = questions.fan_out(adapters.line_transactions(spark, sf_dir), YEARS)
    return questions.birthdays_of(fan, adapters.supplier_stores(spark, sf_dir), adapters.customer_users(spark, sf_dir), YEARS)


# Layouts: tables that are written once for the questions that come.
@query(_SQL["q1_transactions"])
def q1_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a folder a month, in order of the hour."""
    path = fresh_path(spark, "calendar")
    write_calendar(adapters.event_transactions(spark, sf_dir), path)
    found = filters.filter_amount(read_calendar(spark, path, EVENTS), EVENTS.min_amount)
    return found.drop("year_month", "hour_of_day")


@query(f"SELECT year_month, store_id, count(*) AS n FROM (SELECT {MONTH} AS year_month, store_id FROM ({ORDER_TX})) WHERE year_month IN (SELECT DISTINCT {MONTH.replace('created_at', 'l_shipdate')} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-06-01') GROUP BY 1, 2")
def calendar_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that another table names; only their folders are read."""
    path = fresh_path(spark, "calendar")
    write_calendar(adapters.order_transactions(spark, sf_dir), path)
    lines = scan_parquet(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1997-03-01' AND l_shipdate < TIMESTAMP_NTZ '1997-06-01'")
    months = lines.select(year_month(F.col("l_shipdate")).alias("year_month"))
    return of_months(read_calendar(spark, path), months).groupBy("year_month", "store_id").agg(F.count("*").alias("n"))


@query(Q4)
def q4_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are written once by their id; the join leaves them where they are."""
    name = f"users_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_side(adapters.customer_users(spark, sf_dir), "user_id", "birthdate", name, fresh_path(spark, "users"), buckets)
    top = joins.join_stores(ranking.top_buyers(_counts(spark, sf_dir), 3).select("store_id", "user_id", "rank"), adapters.supplier_stores(spark, sf_dir))
    return bucketed_lookup(top, spark, name, "user_id", "birthdate")


# Messages: all tables on one stream of text.
MESSAGE_LINES = (
    f"SELECT 'transactions' AS type, transaction_id || ',' || store_id || ',' || user_id || ',' || printf('%.6f', final_amount) || ',' || strftime(created_at, '%Y-%m-%d %H:%M:%S') AS line FROM ({EVENT_TX})"
    f" UNION ALL SELECT 'transaction_items', item_id || ',' || quantity || ',' || printf('%.6f', subtotal) || ',' || strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM ({ITEMS})"
    " UNION ALL SELECT 'menu', p_partkey || ',' || p_name FROM part UNION ALL SELECT 'store', s_suppkey || ',' || s_name FROM supplier UNION ALL SELECT 'users', c_custkey || ',' || c_name FROM customer"
)


@query(MESSAGE_LINES)
def messages_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of five tables as a message, routed to its table in one pass, and typed again."""
    tables = {"transactions": adapters.event_transactions(spark, sf_dir), "transaction_items": adapters.line_items(spark, sf_dir), "menu": adapters.part_menu(spark, sf_dir), "store": adapters.supplier_stores(spark, sf_dir), "users": adapters.customer_users(spark, sf_dir)}
    path = fresh_path(spark, "messages")
    messages.route(messages.encode(tables, F.lit("c1")).unionByName(messages.end_of(spark, list(tables), "c1")), path)
    out = None
    for name in tables:
        rows = messages.routed(spark, path, name)
        times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in rows.dtypes if t == "timestamp_ntz"}
        lines = as_lines(rows.drop("client").withColumns(times)).select(F.lit(name).alias("type"), "line")
        out = lines if out is None else out.unionByName(lines)
    return out


# Result shapes.
@query(f"""SELECT semester, '{{"' || semester || '":[' || string_agg('"' || store_id || ',' || printf('%.6f', tpv) || '"', ',' ORDER BY store_id) || ']}}' AS json FROM ({TOTALS}) GROUP BY semester""")
def q3_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semester_json(q3_tpv(spark, sf_dir))


@query(f"SELECT semester, store_id, round(tpv, 6) AS tpv FROM ({TOTALS})")
def q3_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_semester_json(q3_json(spark, sf_dir))


@query(f"SELECT semester || ',' || store_id || ',' || printf('%.6f', tpv) AS line FROM ({TOTALS})")
def lines_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(q3_tpv(spark, sf_dir))


# Texts of messages.
@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ',' || c_mktsegment AS rest FROM customer")
def split_at_first_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan_parquet(spark, sf_dir, "customer").select(split_first(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment")).alias("parts"))
    return lines.select(F.get("parts", F.lit(0)).alias("key"), F.get("parts", F.lit(1)).alias("rest"))


@query("SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS client FROM customer")
def short_client_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.md5(F.col("c_custkey").cast("string"))
    dashed = F.regexp_replace(digits, "^(.{6})(.{2})(.{4})(.{4})(.*)$", "$1-$2-$3-$4-$5")
    return scan_parquet(spark, sf_dir, "customer").select("c_custkey", short_id(dashed).alias("client"))


# Streams, run to the end of what is there.
def _streamed(spark: SparkSession, run: Callable[[str, str], None]) -> DataFrame:
    out = fresh_path(spark, "stream-out")
    run(out, fresh_path(spark, "stream-checkpoint"))
    return spark.read.parquet(out)


def _partials(spark: SparkSession, run: Callable[[str, str], None]) -> str:
    out = fresh_path(spark, "partials")
    run(out, fresh_path(spark, "stream-checkpoint"))
    return out


@query(_SQL["q1_transactions"])
def stream_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = adapters.renamed_events(stream_parquet(spark, sf_dir, "events"))
    return _streamed(spark, lambda out, at: jobs.stream_large_transactions(events, EVENTS, out, at))


@query(_SQL["q2_products"])
def stream_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = adapters.as_items(stream_parquet(state_session(spark), sf_dir, "lineitem"))
    out = _partials(spark, lambda out, at: jobs.stream_month_items(items, YEARS, out, at))
    return jobs.month_products(spark, out, adapters.part_menu(spark, sf_dir))


@query(_SQL["q3_tpv"])
def stream_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = state_session(spark)
    orders = adapters.as_orders(stream_parquet(session, sf_dir, "orders"), scan_parquet(session, sf_dir, "customer"))
    return jobs.semester_totals(spark, _partials(spark, lambda out, at: jobs.stream_semester_totals(orders, YEARS, out, at)))


@query(_SQL["q4_top_buyers"])
def stream_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = state_session(spark)
    lines = adapters.as_line_transactions(stream_parquet(session, sf_dir, "lineitem"), scan_parquet(session, sf_dir, "orders"))
    out = _partials(spark, lambda out, at: jobs.stream_store_users(lines, YEARS, out, at))
    return jobs.buyers_birthdays(spark, out, adapters.supplier_stores(spark, sf_dir), adapters.customer_users(spark, sf_dir), YEARS)


# Arrivals: a table dealt into drops that come one after another.
def _arrivals(df: DataFrame, drop: str, name: str, count: int, take: Callable[[DataFrame], None]) -> None:
    """Runs ``take`` on a stream with the rows of ``df`` each time that a drop, the number in column ``drop``, has come.

    A drop is taken before the next one comes, and as one batch, whatever the number of its files: each batch opens
    and commits all of the state, so that batches by the file would grow with the table.
    """
    spark = df.sparkSession
    dealt, folder = fresh_path(spark, f"{name}-dealt"), fresh_path(spark, name)
    df.write.partitionBy(drop).parquet(dealt)
    rows = df.drop(drop)
    stream = state_session(spark).readStream.schema(rows.schema).parquet
    for k in range(count):
        spark.read.schema(df.schema).parquet(dealt).where(F.col(drop) == k).select(rows.columns).write.mode("append").parquet(folder)
        take(stream(folder))


DROPS = 3


@query(f"SELECT semester, store_id, tpv FROM ({TOTALS.replace('1998', '2100').replace('1996', '1900')})")
def stream_partials_of_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three arrivals: one partial table a batch, merged when it is read."""
    orders = adapters.order_transactions(spark, sf_dir).withColumn("_drop", F.pmod(F.hash("transaction_id"), F.lit(DROPS)))
    every = Params(from_year=1900, to_year=2099, from_hour=0, to_hour=23)

    def run(out: str, at: str) -> None:
        _arrivals(orders, "_drop", "drops", DROPS, lambda rows: jobs.stream_semester_totals(rows, every, out, at))

    return jobs.semester_totals(spark, _partials(spark, run))


@query(f"SELECT client_id, semester, store_id, CAST(tpv AS DOUBLE) AS tpv FROM (SELECT o_orderpriority AS client_id, {SEMESTER} AS semester, store_id, sum(CAST(final_amount AS DECIMAL(18,2))) AS tpv FROM ({ORDER_TX}) GROUP BY 1, 2, 3) WHERE client_id NOT LIKE '4%'")
def stream_client_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of five clients, interleaved in three arrivals; the marks of all but one client's end follow."""
    orders = adapters.order_transactions(spark, sf_dir, "o_orderpriority")
    amount = F.col("final_amount").cast("decimal(38,10)")
    rows = orders.select(F.col("o_orderpriority").alias("client_id"), semester(F.col("created_at")).alias("semester"), "store_id", amount.alias("tpv"), F.lit(False).alias("is_end"), F.pmod(F.hash("transaction_id"), F.lit(DROPS)).alias("_drop"))
    marks = end_marks(rows.where("client_id NOT LIKE '4%'").select("client_id").distinct(), rows.drop("_drop")).withColumn("_drop", F.lit(DROPS))

    def run(out: str, at: str) -> None:
        _arrivals(rows.unionByName(marks), "_drop", "clients", DROPS + 1, lambda stream: jobs.stream_client_totals(stream, out, at))

    return _streamed(spark, run).withColumn("tpv", F.col("tpv").cast("double"))


def _text_files(lines: DataFrame, part: str, header: str, folder: str) -> str:
    """Adds to ``folder`` a text file ``part=k`` for each number in column ``part``, a header first; lines (value)."""
    spark = lines.sparkSession
    heads = lines.select(part).distinct().select(F.lit(header).alias("value"), part, F.lit(0).alias("_row"))
    rows = lines.select("value", part, F.lit(1).alias("_row")).unionByName(heads)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, part).sortWithinPartitions(part, "_row", "value").drop("_row").write.mode("append").partitionBy(part).text(folder)
    return folder


def _supplier_files(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers in four files; the second and last hold lines that are too short."""
    suppliers = scan_parquet(spark, sf_dir, "supplier").withColumn("part", (F.col("s_suppkey") % 4).cast("int"))
    short = (F.col("part") == 1) & (F.col("s_suppkey") % 20 == 1) | (F.col("part") == 3) & (F.col("s_suppkey") % 40 == 3)
    line = F.when(short, F.col("s_name")).otherwise(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey"))
    return _text_files(suppliers.select(line.alias("value"), "part"), "part", "store_id,store_name,street", fresh_path(spark, "stores"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS store_id, s_name AS store_name FROM supplier WHERE s_suppkey % 4 IN (0, 2)")
def ingest_good_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(spark, _supplier_files(spark, sf_dir), "part", "store").good.drop(ORDER)


@query("""SELECT CAST(s_suppkey % 4 AS INTEGER) AS part, count(*) AS n_lines, count(*) FILTER (WHERE short) AS n_bad, min(s_name) FILTER (WHERE short) AS line, 'store: under 3 fields: 1' AS reason
FROM (SELECT *, s_suppkey % 20 = 1 AND s_suppkey % 4 = 1 OR s_suppkey % 40 = 3 AS short FROM supplier) WHERE s_suppkey % 4 IN (1, 3) GROUP BY 1 HAVING count(*) FILTER (WHERE short) > 0""")
def ingest_rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = ingest(spark, _supplier_files(spark, sf_dir), "part", "store").rejects
    return rejects.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), "n_lines", "n_bad", "line", "reason")


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'drop ' || CASE WHEN c_custkey % 3 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS birthdate FROM customer")
def stream_text_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in three drops of text files, taken as they come: the last line of an id counts."""
    drop = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), (F.col("c_custkey") % (k + 1) == 0).alias("here")) for k in range(3)))).alias("d")
    users = scan_parquet(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", drop).where("d.here")
    lines = users.select(F.concat_ws(",", "c_custkey", "c_mktsegment", F.concat(F.lit("drop "), F.col("d.part").cast("string")), F.lit("x")).alias("value"), F.col("d.part").alias("part"))
    folder, out, at = fresh_path(spark, "users"), fresh_path(spark, "landed"), fresh_path(spark, "stream-checkpoint")
    for k in range(3):
        _text_files(lines.where(F.col("part") == k), "part", "user_id,gender,birthdate,registered_at", folder)
        land(spark, folder, "part", "users", out, at)
    return joins.last_wins(landed(spark, out, "users"), "user_id", "birthdate")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
