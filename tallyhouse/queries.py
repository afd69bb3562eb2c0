"""The library's queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.engine import Engine
from tallyhouse.refusal import Refused

TABLES = {"region": None, "nation": None, "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}


def folder(spark: SparkSession) -> str:
    """Where managed tables of a query go: the shared checkpoint folder, or a temporary one in local runs without it."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{there.rstrip('/')}/engine-{uuid.uuid4().hex}" if there else tempfile.mkdtemp(prefix="engine-")


def engine(spark: SparkSession, sf_dir: str, *names: str, managed: bool = False) -> Engine:
    """An engine with test tables attached, ids where a column is one; decimal and date columns that the tables lack are derived."""
    e = Engine(spark, folder(spark) if managed else None)
    for name in names or TABLES:
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "orders":
            frame = frame.withColumn("o_day", F.to_date("o_orderdate")).withColumn("o_price", F.col("o_totalprice").cast("decimal(12,2)")).withColumn("o_custkey", F.col("o_custkey").cast("long")).withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
        if name == "events":
            frame = frame.withColumn("cents", F.col("value").cast("decimal(18,2)")).withColumn("day", F.to_date("ts"))
        e.attach(name, frame, TABLES.get(name))
    return e


def visits(spark: SparkSession, sf_dir: str) -> Engine:
    """A table of users with the types of their events as a set, and as a time quantum."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.collect_list(F.struct(F.col("event_type").alias("key"), F.col("ts").alias("at"))).alias("visit"), F.count(F.lit(1)).alias("n_events"))
    e = Engine(spark)
    e.attach("users", users, "user_id")
    return e


#: Name: (statement in the dialect, the same in DuckDB).
SQL: dict[str, tuple[str, str]] = {
    "count_all": ("SELECT count(*) AS n FROM events", "SELECT count(*) AS n FROM events"),
    "count_ge": ("SELECT count(*) AS n FROM events WHERE value >= 75", "SELECT count(*) AS n FROM events WHERE value >= 75"),
    "intersect_count": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 100000", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 100000"),
    "union_count": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 50000", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 50000"),
    "not_count": ("SELECT count(*) AS n FROM orders WHERE NOT o_totalprice > 100000", "SELECT count(*) AS n FROM orders WHERE NOT coalesce(o_totalprice > 100000, FALSE)"),
    "difference_count": ("SELECT count(*) AS n FROM orders WHERE o_totalprice > 50000 AND NOT o_orderstatus = 'O' AND NOT o_orderpriority = '5-LOW'", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 50000 AND o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW'"),
    "in_list": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "not_in_list": ("SELECT count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "SELECT count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "between": ("SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20"),
    "like": ("SELECT count(*) AS n FROM part WHERE p_type LIKE '%A%'", "SELECT count(*) AS n FROM part WHERE p_type LIKE '%A%'"),
    "ilike": ("SELECT count(*) AS n FROM customer WHERE c_mktsegment ILIKE 'b%g' OR c_mktsegment NOT LIKE '%U%'", "SELECT count(*) AS n FROM customer WHERE c_mktsegment ILIKE 'b%g' OR c_mktsegment NOT LIKE '%U%'"),
    "decimal_compare": ("SELECT count(*) AS n FROM orders WHERE o_price >= 1234.5", "SELECT count(*) AS n FROM orders WHERE CAST(o_totalprice AS DECIMAL(12,2)) >= 1234.5"),
    "date_compare": ("SELECT count(*) AS n FROM orders WHERE o_day >= '1996-01-01' AND o_day < '1997-06-01'", "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1997-06-01'"),
    "prewhere": ("SELECT count(*) AS n FROM events PREWHERE event_type = 'click' WHERE value > 10", "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value > 10"),
    "round_where": ("SELECT count(*) AS n FROM events WHERE round(cents, 1) >= 12.3", "SELECT count(*) AS n FROM events WHERE round(CAST(value AS DECIMAL(18,2)), 1) >= 12.3"),
    "floor_where": ("SELECT count(*) AS n FROM events WHERE floor(cents) = 12 OR ceil(cents) = 40", "SELECT count(*) AS n FROM events WHERE floor(CAST(value AS DECIMAL(18,2))) = 12 OR ceil(CAST(value AS DECIMAL(18,2))) = 40"),
    "date_trunc_where": ("SELECT count(*) AS n FROM orders WHERE date_trunc('month', o_orderdate) = '1996-03-01' OR toYear(o_orderdate) = 1994", "SELECT count(*) AS n FROM orders WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1996-03-01' OR year(o_orderdate) = 1994"),
    "to_date_where": ("SELECT count(*) AS n FROM events WHERE toDate(ts) > '2024-01-10'", "SELECT count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-10'"),
    "semi_join": ("SELECT count(*) AS n, sum(o_price) AS total FROM orders WHERE o_custkey IN (SELECT _record_id FROM customer WHERE c_mktsegment = 'BUILDING')", "SELECT count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "anti_join": ("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT _record_id FROM customer WHERE c_acctbal > 0)", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "member_in_or": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN (SELECT _record_id FROM customer WHERE c_mktsegment = 'MACHINERY')", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"),
    "sample": ("SELECT count(*) AS n, sum(cents) AS total FROM events SAMPLE 1/10", "SELECT count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events WHERE event_id % 10 = 0"),
    "sum_where": ("SELECT sum(cents) AS total FROM events WHERE event_type = 'purchase'", "SELECT coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS total FROM events WHERE event_type = 'purchase'"),
    "sum_over_nothing": ("SELECT sum(cents) AS total, min(cents) AS low, count(*) AS n FROM events WHERE value < 0 AND value > 1", "SELECT CAST(0 AS DECIMAL(38,2)) AS total, min(CAST(value AS DECIMAL(18,2))) AS low, count(*) AS n FROM events WHERE value < 0 AND value > 1"),
    "min_max": ("SELECT min(cents) AS low, max(cents) AS high, min(ts) AS first, max(day) AS last FROM events", "SELECT min(CAST(value AS DECIMAL(18,2))) AS low, max(CAST(value AS DECIMAL(18,2))) AS high, min(ts) AS first, max(CAST(ts AS DATE)) AS last FROM events"),
    "avg": ("SELECT round(avg(l_quantity), 4) AS mean FROM lineitem", "SELECT round(sum(l_quantity) / count(*), 4) AS mean FROM lineitem"),
    "median": ("SELECT median(cents) AS mid FROM events", "SELECT quantile_disc(CAST(value AS DECIMAL(18,2)), 0.5) AS mid FROM events"),
    "quantile_p25": ("SELECT quantile(0.25)(p_size) AS q25, quantileExact(0.9)(p_size) AS q90 FROM part", "SELECT CAST(quantile_disc(p_size, 0.25) AS INTEGER) AS q25, CAST(quantile_disc(p_size, 0.9) AS INTEGER) AS q90 FROM part"),
    "group_quantile": ("SELECT event_type, median(cents) AS mid FROM events GROUP BY event_type", "SELECT event_type, quantile_disc(CAST(value AS DECIMAL(18,2)), 0.5) AS mid FROM events GROUP BY event_type"),
    "topk_list": ("SELECT topK(2)(event_type) AS top FROM events", "SELECT list(event_type ORDER BY n DESC, event_type) AS top FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 2)"),
    "count_distinct": ("SELECT count(DISTINCT o_orderpriority) AS n, uniq(o_orderstatus) AS m FROM orders", "SELECT count(DISTINCT o_orderpriority) AS n, count(DISTINCT o_orderstatus) AS m FROM orders"),
    "filter_agg": ("SELECT count(*) FILTER (WHERE value > 50) AS big, sum(cents) FILTER (WHERE event_type = 'view') AS seen, avg(cents) FILTER (WHERE value > 200000) AS none FROM events", "SELECT count(*) FILTER (WHERE value > 50) AS big, coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'view'), 0) AS seen, avg(value) FILTER (WHERE value > 200000) AS none FROM events"),
    "if_agg": ("SELECT countIf(value > 50) AS big, sumIf(cents, event_type = 'click') AS clicked, maxIf(cents, value < 20) AS high, uniqIf(event_type, value > 90) AS kinds FROM events", "SELECT count(*) FILTER (WHERE value > 50) AS big, coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'click'), 0) AS clicked, max(CAST(value AS DECIMAL(18,2))) FILTER (WHERE value < 20) AS high, count(DISTINCT event_type) FILTER (WHERE value > 90) AS kinds FROM events"),
    "aggregate_expression": ("SELECT round(sum(cents) / count(*), 3) AS mean, max(cents) - min(cents) AS spread FROM events", "SELECT round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 3) AS mean, max(CAST(value AS DECIMAL(18,2))) - min(CAST(value AS DECIMAL(18,2))) AS spread FROM events"),
    "having_whole": ("SELECT count(*) AS n FROM events HAVING count(*) > 1000000000", "SELECT count(*) AS n FROM events HAVING count(*) > 1000000000"),
    "group_count": ("SELECT event_type, count(*) AS n FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "group_sum": ("SELECT o_orderpriority, sum(o_price) AS total, min(o_day) AS first, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total, min(CAST(o_orderdate AS DATE)) AS first, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_orderpriority"),
    "group_bucket_month": ("SELECT date_trunc('month', o_day) AS m, count(*) AS n FROM orders GROUP BY date_trunc('month', o_day)", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1"),
    "group_bucket_week": ("SELECT date_trunc('week', ts) AS w, sum(cents) AS total FROM events GROUP BY date_trunc('week', ts)", "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1"),
    "group_tuple": ("SELECT o_orderstatus, o_orderpriority, date_trunc('year', o_day) AS y, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, date_trunc('year', o_day)", "SELECT o_orderstatus, o_orderpriority, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus WITH CUBE", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())"),
    "rollup_over_nothing": ("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY o_orderstatus WITH ROLLUP", "SELECT CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(0 AS BIGINT) AS n"),
    "distinct_cols": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "having": ("SELECT p_brand, count(*) AS n, sum(p_size) AS total FROM part GROUP BY p_brand HAVING count(*) >= 5 AND NOT sum(p_size) < 200", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand HAVING count(*) >= 5 AND NOT sum(p_size) < 200"),
    "top_n": ("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY count(*) DESC LIMIT 5", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5"),
    "limit_with_ties": ("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY count(*) DESC LIMIT 3 WITH TIES", "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM part GROUP BY p_brand) WHERE r <= 3"),
    "offset_page": ("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY count(*) DESC LIMIT 4 OFFSET 3", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 4 OFFSET 3"),
    "union_all": ("SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type", "SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1"),
    "join_inner_count": ("SELECT count(*) AS n, sum(c.c_custkey) AS ids FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "join_inner_group": ("SELECT c.c_nationkey AS nation, count(*) AS n, max(s.s_suppkey) AS top FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey GROUP BY c.c_nationkey HAVING count(*) > 1 ORDER BY count(*) DESC LIMIT 10", "SELECT c_nationkey AS nation, count(*) AS n, max(s_suppkey) AS top FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, nation LIMIT 10"),
    "join_left": ("SELECT count(*) AS n, sum(c.c_custkey) AS ids FROM customer c LEFT JOIN supplier s ON c.c_nationkey = s.s_nationkey", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey"),
    "join_right": ("SELECT count(*) AS n, sum(s.s_suppkey) AS ids FROM customer c RIGHT JOIN supplier s ON c.c_nationkey = s.s_nationkey", "SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS ids FROM customer RIGHT JOIN supplier ON c_nationkey = s_nationkey"),
    "join_full": ("SELECT count(*) AS n, count(DISTINCT c.c_nationkey) AS keys FROM customer c FULL JOIN supplier s ON c.c_nationkey = s.s_nationkey", "SELECT count(*) AS n, count(DISTINCT coalesce(c_nationkey, s_nationkey)) AS keys FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey"),
    "join_three_way_star": ("SELECT count(*) AS n, sum(n.n_nationkey) AS ids FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS ids FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON c_nationkey = n_nationkey"),
    "join_avg": ("SELECT round(avg(s.s_suppkey), 4) AS mean, min(c.c_custkey) AS low FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_mktsegment = 'BUILDING' AND s.s_suppkey > 3", "SELECT round(avg(s_suppkey), 4) AS mean, min(c_custkey) AS low FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING' AND s_suppkey > 3"),
    "join_self": ("SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'MACHINERY'", "SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_mktsegment = 'BUILDING' AND b.c_mktsegment = 'MACHINERY'"),
    "join_record_id": ("SELECT o.o_orderpriority AS p, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c._record_id WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 1000 GROUP BY o.o_orderpriority", "SELECT o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 GROUP BY 1"),
    "scalar_math": ("SELECT event_id, abs(cents - 50) AS a, round(sqrt(value), 6) AS b, floor(cents) AS c, ceil(cents) AS d, round(ln(value + 1), 6) AS e, round(pow(value, 2), 6) AS f, sign(value - 50) AS g, value / 0 AS h, event_id % 7 AS i, round(log10(value + 1), 6) AS j, round(exp(value / 100), 6) AS k FROM events", "SELECT event_id, abs(CAST(value AS DECIMAL(18,2)) - 50) AS a, round(sqrt(value), 6) AS b, CAST(floor(CAST(value AS DECIMAL(18,2))) AS DECIMAL(17,0)) AS c, CAST(ceil(CAST(value AS DECIMAL(18,2))) AS DECIMAL(17,0)) AS d, round(ln(value + 1), 6) AS e, round(value * value, 6) AS f, CAST(sign(value - 50) AS INTEGER) AS g, CAST(NULL AS DOUBLE) AS h, event_id % 7 AS i, round(log10(value + 1), 6) AS j, round(exp(value / 100), 6) AS k FROM events"),
    "scalar_bit": ("SELECT event_id, bitAnd(user_id, 12) AS a, bitOr(user_id, 3) AS b, bitXor(user_id, 5) AS c, bitNot(user_id) AS d, bitShiftLeft(user_id, 3) AS e, bitShiftRight(user_id, 2) AS f FROM events", "SELECT event_id, user_id & 12 AS a, user_id | 3 AS b, xor(user_id, 5) AS c, ~user_id AS d, user_id << 3 AS e, user_id >> 2 AS f FROM events"),
    "scalar_string": ("SELECT event_id, upper(event_type) AS a, length(event_type) AS b, substring(event_type, 0, 3) AS c, position(event_type, 'i') AS d, concat(event_type, '-', props) AS e, reverse(event_type) AS f, startsWith(event_type, 'c') AS g, endsWith(event_type, 'k') AS h, trim(concat('  ', event_type, ' ')) AS i FROM events", "SELECT event_id, upper(event_type) AS a, CAST(length(event_type) AS INTEGER) AS b, substring(event_type, 1, 3) AS c, CAST(instr(event_type, 'i') AS INTEGER) AS d, event_type || '-' || props AS e, reverse(event_type) AS f, CAST(starts_with(event_type, 'c') AS INTEGER) AS g, CAST(ends_with(event_type, 'k') AS INTEGER) AS h, event_type AS i FROM events"),
    "split_by_char": ("SELECT o_orderkey, splitByChar('-', o_orderpriority) AS parts FROM orders", "SELECT o_orderkey, string_split(o_orderpriority, '-') AS parts FROM orders"),
    "scalar_cast": ("SELECT event_id, toInt64(value) AS a, toFloat64(user_id) AS b, toString(event_id) AS c, CAST(cents AS text) AS d, toInt64(event_type) AS e FROM events", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS a, CAST(user_id AS DOUBLE) AS b, CAST(event_id AS VARCHAR) AS c, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS d, CAST(NULL AS BIGINT) AS e FROM events"),
    "scalar_choice": ("SELECT event_id, CASE WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'mid' ELSE 'low' END AS a, if(event_type = 'click', 1, 0) AS b, multiIf(value > 90, 'x', value > 50, 'y', 'z') AS c, coalesce(nullIf(event_type, 'view'), 'none') AS d, value > 10 AND NOT event_type = 'view' AS e FROM events", "SELECT event_id, CASE WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'mid' ELSE 'low' END AS a, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS b, CASE WHEN value > 90 THEN 'x' WHEN value > 50 THEN 'y' ELSE 'z' END AS c, coalesce(nullif(event_type, 'view'), 'none') AS d, CAST(value > 10 AND event_type <> 'view' AS INTEGER) AS e FROM events"),
    "scalar_date_parts": ("SELECT event_id, toYear(ts) AS a, toMonth(ts) AS b, toDayOfMonth(ts) AS c, toHour(ts) AS d, toMinute(ts) AS e, toSecond(ts) AS f FROM events", "SELECT event_id, CAST(year(ts) AS INTEGER) AS a, CAST(month(ts) AS INTEGER) AS b, CAST(day(ts) AS INTEGER) AS c, CAST(hour(ts) AS INTEGER) AS d, CAST(minute(ts) AS INTEGER) AS e, CAST(second(ts) AS INTEGER) AS f FROM events"),
    "scalar_date_trunc": ("SELECT event_id, date_trunc('hour', ts) AS a, date_trunc('week', day) AS b, date_trunc('quarter', ts) AS c, toDate(ts) AS d FROM events", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS a, CAST(date_trunc('week', ts) AS DATE) AS b, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS c, CAST(ts AS DATE) AS d FROM events"),
    "scalar_date_diff": ("SELECT o_orderkey, date_diff('day', o_day, toDate('1998-01-01')) AS a, date_diff('month', o_day, toDate('1998-01-31')) AS b, date_diff('week', o_day, toDate('1998-01-01')) AS c, date_diff('year', o_day, toDate('1998-01-01')) AS d, date_diff('hour', o_orderdate, toDate('1998-01-01')) AS e FROM orders", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS a, date_diff('month', CAST(o_orderdate AS DATE), DATE '1998-01-31') AS b, CAST(date_diff('day', CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE), CAST(date_trunc('week', DATE '1998-01-01') AS DATE)) // 7 AS BIGINT) AS c, CAST(floor(date_diff('month', CAST(o_orderdate AS DATE), DATE '1998-01-01') / 12.0) AS BIGINT) AS d, date_diff('hour', o_orderdate, TIMESTAMP '1998-01-01') AS e FROM orders"),
    "scalar_date_add": ("SELECT o_orderkey, date_add('month', 1, o_day) AS a, date_sub('year', 2, o_day) AS b, date_add('hour', 5, o_orderdate) AS c, date_add('week', 1, o_day) AS d, o_day + 3 AS e, o_day - toDate('1995-01-01') AS f FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 YEAR AS DATE) AS b, CAST(o_orderdate + INTERVAL 5 HOUR AS TIMESTAMP) AS c, CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS d, CAST(o_orderdate AS DATE) + 3 AS e, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS f FROM orders"),
    "format_datetime": ("SELECT event_id, formatDateTime(ts, '%d/%m/%Y %H:%M:%S %F %%') AS a FROM events", "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S %Y-%m-%d') || ' %' AS a FROM events"),
    "json_extract": ("SELECT event_id, JSONExtractInt(props, 'k') AS a, JSONExtractString(props, 'k') AS b, JSONHas(props, 'k') AS c, JSONHas(props, 'z') AS d, JSONExtractRaw(props, 'k') AS e, JSONExtractFloat(props, 'k') AS f FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS a, CAST(NULL AS VARCHAR) AS b, CAST(json_exists(props, '$.k') AS INTEGER) AS c, 0 AS d, CAST(json_extract(props, '$.k') AS VARCHAR) AS e, CAST(json_extract(props, '$.k') AS DOUBLE) AS f FROM events"),
    "project_order_limit": ("SELECT o_orderstatus, o_price FROM orders ORDER BY o_price DESC LIMIT 20", "SELECT o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_price FROM orders ORDER BY 2 DESC, o_orderkey LIMIT 20"),
    "project_star": ("SELECT * FROM nation", "SELECT * FROM nation"),
    "record_ids": ("SELECT _record_id FROM orders WHERE o_totalprice > 300000", "SELECT o_orderkey AS _record_id FROM orders WHERE o_totalprice > 300000"),
    "numbers": ("SELECT number FROM numbers(100)", "SELECT range AS number FROM range(100)"),
    "bool_equality": ("SELECT count(*) AS n, countIf(urgent = false) AS rest FROM orders WHERE urgent = true OR NOT urgent", "SELECT count(*) AS n, count(*) FILTER (o_orderpriority <> '1-URGENT') AS rest FROM orders"),
    "now_literal": ("SELECT count(*) AS n, countIf(day > now()) AS later FROM events WHERE ts <= now()", "SELECT count(*) AS n, count(*) FILTER (CAST(ts AS DATE) > current_date) AS later FROM events WHERE ts <= now()::TIMESTAMP"),
    "distinct_bucket": ("SELECT DISTINCT date_trunc('quarter', o_day) AS q FROM orders", "SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q FROM orders"),
    "join_no_shared_key": ("SELECT count(*) AS n, sum(c.c_custkey) AS ids FROM customer c JOIN part p ON c.c_mktsegment = p.p_brand", "SELECT count(*) AS n, CAST(coalesce(sum(c_custkey), 0) AS BIGINT) AS ids FROM customer JOIN part ON c_mktsegment = p_brand"),
    "window_after_where": ("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY cents DESC) AS v FROM events WHERE value >= 50 ORDER BY event_id LIMIT 40", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY CAST(value AS DECIMAL(18,2)) DESC, event_id) AS INTEGER) AS v FROM events WHERE value >= 50 ORDER BY event_id LIMIT 40"),
    "having_order_offset_ties": ("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1 ORDER BY count(*) DESC LIMIT 3 OFFSET 2 WITH TIES", "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY p_brand HAVING count(*) > 1) WHERE k > 2 AND r <= 5"),
    "scalar_more": ("SELECT event_id, -user_id AS a, lower(upper(event_type)) AS b, ltrim(concat('  ', event_type)) AS c, rtrim(concat(event_type, '  ')) AS d, ifNull(nullIf(event_type, 'click'), 'none') AS e, round(log2(value + 1), 6) AS f, -(cents - 1) AS g, NOT value > 50 AS h FROM events", "SELECT event_id, -user_id AS a, event_type AS b, event_type AS c, event_type AS d, coalesce(nullif(event_type, 'click'), 'none') AS e, round(log2(value + 1), 6) AS f, -(CAST(value AS DECIMAL(18,2)) - 1) AS g, CAST(NOT value > 50 AS INTEGER) AS h FROM events"),
    "group_quantile_levels": ("SELECT o_orderpriority, quantile(0.1)(o_price) AS low, quantile(0.95)(o_price) AS high FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, quantile_disc(CAST(o_totalprice AS DECIMAL(12,2)), 0.1) AS low, quantile_disc(CAST(o_totalprice AS DECIMAL(12,2)), 0.95) AS high FROM orders GROUP BY 1"),
    "constants": ("WITH 'click' AS kind, 20 AS low SELECT count(*) AS n FROM events WHERE event_type = kind AND value >= low", "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND value >= 20"),
}

_WINDOWS = {
    "row_number": ("row_number() OVER (PARTITION BY user_id ORDER BY cents)", "row_number() OVER (w ORDER BY cents, event_id)"),
    "rank": ("rank() OVER (PARTITION BY user_id ORDER BY event_type DESC)", "rank() OVER (w ORDER BY event_type DESC)"),
    "dense_rank": ("dense_rank() OVER (PARTITION BY user_id ORDER BY event_type)", "dense_rank() OVER (w ORDER BY event_type)"),
    "ntile": ("ntile(3) OVER (PARTITION BY user_id ORDER BY cents)", "ntile(3) OVER (w ORDER BY cents, event_id)"),
    "percent_rank": ("percent_rank() OVER (PARTITION BY user_id ORDER BY event_type)", "percent_rank() OVER (w ORDER BY event_type)"),
    "cume_dist": ("cume_dist() OVER (PARTITION BY user_id ORDER BY event_type)", "cume_dist() OVER (w ORDER BY event_type)"),
    "lag": ("lag(cents) OVER (PARTITION BY user_id ORDER BY ts)", "lag(cents) OVER (w ORDER BY ts, event_id)"),
    "lead": ("lead(cents, 2) OVER (PARTITION BY user_id ORDER BY ts)", "lead(cents, 2) OVER (w ORDER BY ts, event_id)"),
    "first_value": ("first_value(cents) OVER (PARTITION BY user_id ORDER BY ts)", "first_value(cents) OVER (w ORDER BY ts, event_id)"),
    "last_value": ("last_value(cents) OVER (PARTITION BY user_id ORDER BY ts)", "last_value(cents) OVER (w ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "nth_value": ("nth_value(cents, 2) OVER (PARTITION BY user_id ORDER BY ts)", "nth_value(cents, 2) OVER (w ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "win_sum": ("sum(cents) OVER (PARTITION BY user_id)", "sum(cents) OVER w"),
    "win_avg": ("avg(value) OVER (PARTITION BY user_id)", "avg(value) OVER w"),
    "win_count": ("count(*) OVER (PARTITION BY user_id)", "count(*) OVER w"),
    "win_min": ("min(cents) OVER (PARTITION BY event_type)", "min(cents) OVER (PARTITION BY event_type)"),
    "win_max": ("max(cents) OVER (PARTITION BY event_type)", "max(cents) OVER (PARTITION BY event_type)"),
    "running_difference": ("runningDifference(cents) OVER (PARTITION BY user_id ORDER BY ts)", "cents - lag(cents) OVER (w ORDER BY ts, event_id)"),
}
for _name, (_ours, _theirs) in _WINDOWS.items():
    _cast = {"row_number": "INTEGER", "rank": "INTEGER", "dense_rank": "INTEGER", "ntile": "INTEGER"}.get(_name)
    _value = f"CAST({_theirs} AS {_cast})" if _cast else f"round({_theirs}, 6)" if _name in ("win_avg", "percent_rank", "cume_dist") else _theirs
    SQL[_name] = (f"SELECT event_id, {_ours} AS v FROM events", f"SELECT event_id, {_value} AS v FROM (SELECT *, CAST(value AS DECIMAL(18,2)) AS cents FROM events) WINDOW w AS (PARTITION BY user_id)")


def statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = set(text.replace("(", " ").replace(")", " ").split())
        used = [t for t in TABLES if t in words] or ["region"]
        return plain(engine(spark, sf_dir, *used).sql(text))

    return run


def plain(out: DataFrame) -> DataFrame:
    """The rows with types that both engines spell alike: times without a zone, sums of decimals at full width, window averages to six places."""
    casts = {}
    for name, kind in out.dtypes:
        if kind == "timestamp":
            casts[name] = F.col(name).cast("timestamp_ntz")
        elif kind.startswith("decimal(") and int(kind[8:].split(",")[0]) > 18:
            casts[name] = F.col(name).cast(f"decimal(38,{kind[:-1].split(',')[1]})")
        elif kind == "double" and name == "v":
            casts[name] = F.round(name, 6)
    return out.withColumns(casts) if casts else out


# --- queries that aren't one statement over attached tables


def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a purchase in whole days of January 2024, by the time-quantum column."""
    return visits(spark, sf_dir).sql("SELECT count(*) AS n, sum(n_events) AS total FROM users WHERE visit = 'purchase' AND visit BETWEEN 1704844800 AND 1705449599")


def set_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by a multi-valued column: a user is in one group for each type."""
    return visits(spark, sf_dir).sql("SELECT types, count(*) AS n, sum(n_events) AS total FROM users WHERE types = 'click' GROUP BY types")


def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).sql("SELECT uniq(types) AS n, topK(2)(types) AS top, count(*) AS users FROM users WHERE types LIKE '%i%'")


def view_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders", managed=True)
    e.sql("CREATE VIEW big AS SELECT o_orderpriority AS p, o_price FROM orders WHERE o_totalprice > 150000")
    return e.sql("SELECT p, count(*) AS n FROM big WHERE o_price < 400000 GROUP BY p UNION ALL SELECT o_orderstatus, count(*) FROM orders WHERE NOT SEGMENT(big) GROUP BY o_orderstatus")


def calls_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "events")
    return e.pql("events", 'TopN(Difference(All(), Row(value < 20)), field="event_type", n=3)')


def calls_group_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    return e.pql("orders", 'GroupByTuple(Union(Row(o_orderstatus="F"), Row(o_totalprice > 200000)), by=o_orderpriority, by=Bucket(o_day, "year", 100), aggregate=Sum(field=o_price))').toDF("priority", "year", "total")


def managed_events(spark: SparkSession, sf_dir: str) -> Engine:
    """A managed table filled by INSERT … SELECT."""
    e = engine(spark, sf_dir, "orders", managed=True)
    e.sql("CREATE TABLE own (status MUTEX, priority MUTEX, price DECIMAL(12, 2), day DATE)")
    e.sql("INSERT INTO own (status, priority, price, day) SELECT o_orderstatus, o_orderpriority, o_price, o_day FROM orders")
    return e


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return managed_events(spark, sf_dir).sql("SELECT status, priority, count(*) AS n, sum(price) AS total, max(day) AS last FROM own GROUP BY status, priority")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = managed_events(spark, sf_dir)
    e.sql("DELETE FROM own WHERE status = 'F' AND price > 100000")
    return e.sql("SELECT status, count(*) AS n, sum(price) AS total FROM own GROUP BY status")


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = managed_events(spark, sf_dir)
    e.sql("UPDATE own SET priority = 'none', price = 1.5 WHERE status = 'O' AND NOT price > 50000")
    return e.sql("SELECT priority, count(*) AS n, sum(price) AS total FROM own GROUP BY priority")


def fact_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as text, made from events, read into a table with a set, a decimal in stored units and a time quantum."""
    from tallyhouse.sources.facts import import_facts

    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE seen (kind SET, cents DECIMAL(12, 2), visit TIMEQUANTUM)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long")
    lines = events.select(F.explode(F.array(
        F.concat_ws(" ", F.lit("kind"), "user_id", "event_type"),
        F.concat_ws(" ", F.lit("visit"), "user_id", F.concat("event_type", F.lit("@"), F.unix_timestamp("ts"))),
    )).alias("value"))
    top = events.groupBy("user_id").agg(F.max(cents).alias("c")).select(F.concat_ws(" ", F.lit("cents"), "user_id", "c").alias("value"))
    import_facts(e.store, "seen", lines.unionByName(top))
    return e.sql("SELECT kind, count(*) AS n, sum(cents) AS total FROM seen WHERE visit = 'view' AND visit >= 1704672000 GROUP BY kind")


def watch_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer that a live query gives while events arrive in batches."""
    from tallyhouse.streaming.live import replayed

    return replayed(spark, sf_dir)


def member_of_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A membership beside another condition, in a table whose record ids repeat: each record counts once."""
    e = engine(spark, sf_dir, "customer")
    e.attach("bought", spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_custkey", F.col("o_custkey").cast("long")), "o_custkey")
    return e.sql("SELECT count(*) AS n, sum(c_custkey) AS ids FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT _record_id FROM bought WHERE o_totalprice > 100000)")


def multi_valued_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(spark, sf_dir).sql("SELECT _record_id, types, n_events FROM users WHERE types = 'view'")


def regions(spark: SparkSession, sf_dir: str) -> Engine:
    """A managed table of regions, written by INSERT … VALUES, with a column of several keys."""
    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE areas (name MUTEX, size UINT(32), tags SET)")
    e.sql("INSERT INTO areas (name, size, tags) VALUES ('north', 10, 'cold'), ('south', 25, 'warm'), ('west', 7, 'wet')")
    return e


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions(spark, sf_dir)
    e.sql("INSERT INTO areas (_record_id, size, tags) VALUES (2, 26, 'dry'), (9, 3, 'far')")
    e.sql("INSERT INTO areas (name) VALUES ('last')")
    return e.sql("SELECT _record_id, name, size, tags FROM areas")


def insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = managed_events(spark, sf_dir)
    e.sql("CREATE TABLE dear (price DECIMAL(12, 2), status MUTEX)")
    for low in (100000, 300000):
        e.sql(f"INSERT OVERWRITE TABLE dear (price, status) SELECT price, status FROM own WHERE price > {low}")
    return e.sql("SELECT status, count(*) AS n, sum(price) AS total, max(price) AS top FROM dear GROUP BY status")


def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions(spark, sf_dir)
    gone = e.delete_ids("areas", spark.createDataFrame([(1,), (3,), (3,), (50,)], "id long"))
    return e.sql("SELECT _record_id, name FROM areas").withColumn("gone", F.lit(gone).cast("long"))


def record_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    return e.records("orders", after=100, limit=50)


def alter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions(spark, sf_dir)
    e.sql("ALTER TABLE areas ADD COLUMN rank SIGNED(16)")
    e.sql("INSERT INTO areas (_record_id, rank) VALUES (1, -5)")
    e.sql("ALTER TABLE areas DROP COLUMN tags")
    return e.sql("SELECT * FROM areas")


def rename_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions(spark, sf_dir)
    e.sql("CREATE TABLE empty (size UINT(8))")
    e.sql("ALTER TABLE areas RENAME TO places")
    e.sql("EXCHANGE TABLES places AND empty")
    e.sql("CREATE TABLE gone (a SET)")
    e.sql("DROP TABLE gone")
    return e.sql("SELECT count(*) AS n, sum(size) AS total FROM empty UNION ALL SELECT count(*), sum(size) FROM places")


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions(spark, sf_dir)
    e.sql("TRUNCATE TABLE areas")
    e.sql("INSERT INTO areas (name) VALUES ('first again')")
    return e.sql("SELECT _record_id, name, size FROM areas")


def drop_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a managed table by day, after the days before the 8th are gone: the windows' counts, and that of the key."""
    from tallyhouse.sources.facts import import_facts

    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE seen (visit TIMEQUANTUM)")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    import_facts(e.store, "seen", events.select(F.concat_ws(" ", F.lit("visit"), "user_id", F.concat("event_type", F.lit("@"), F.unix_timestamp("ts"))).alias("value")))
    e.sql("ALTER TABLE seen DROP DAYS BEFORE '2024-01-08' ON visit")
    counts = ["visit = 'click'", "visit = 'click' AND visit <= 1704844799", "visit = 'click' AND visit BETWEEN 1704672000 AND 1704758399", "NOT (visit = 'click' AND visit >= 1704067200)"]
    return e.sql(" UNION ALL ".join(f"SELECT count(*) AS n FROM seen WHERE {c}" for c in counts))


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two databases: one name in both, a join across them, and what is left when one goes."""
    e = regions(spark, sf_dir)
    e.sql("CREATE DATABASE other")
    e.sql("CREATE TABLE other.areas (name MUTEX, size UINT(32))")
    e.sql("INSERT INTO other.areas (name, size) VALUES ('north', 1), ('north', 2), ('east', 3)")
    joined = e.sql("SELECT count(*) AS n, sum(b.size) AS total FROM areas a JOIN other.areas b ON a.name = b.name").collect()[0]
    own = e.sql("SELECT count(*) AS n, sum(size) AS total FROM areas", database="other").collect()[0]
    e.sql("CREATE DATABASE spare")
    e.sql("DROP DATABASE other CASCADE")
    left = e.sql("SHOW DATABASES").collect()
    return spark.createDataFrame([("joined", joined.n, joined.total), ("own", own.n, own.total), *((r.name, r.tables, None) for r in left)], "what string, n long, total long")


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SHOW and DESCRIBE tell of a table, its fields, views and statement."""
    e = regions(spark, sf_dir)
    e.sql("CREATE VIEW cold AS SELECT name FROM areas WHERE tags = 'cold'")
    rows = [("table", r.name, str(r.fields)) for r in e.sql("SHOW TABLES").collect()]
    rows += [("column", r.name, r.kind) for r in e.sql("DESCRIBE TABLE areas").collect()] + [("view", r.name, r.statement) for r in e.sql("SHOW VIEWS").collect()]
    rows += [("create", "areas", " ".join(e.sql("SHOW CREATE TABLE areas").first()[0].split()))]
    return spark.createDataFrame(rows, "what string, name string, of string")


def system_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions(spark, sf_dir)
    e.sql("CREATE VIEW cold AS SELECT name FROM areas WHERE tags = 'cold'")
    parts = [e.sql(f"SELECT {c} FROM system.{t} WHERE {w}") for c, t, w in (("name, type", "tables", "database = 'default'"), ("name, kind", "columns", "table = 'areas'"), ("name, name", "databases", "database = 'default'"))]
    return parts[0].toDF("name", "of").union(parts[1].toDF("name", "of")).union(parts[2].toDF("name", "of"))


def system_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = regions(spark, sf_dir)
    e.sql("INSERT INTO areas (_record_id, size) VALUES (1048577, 5)")
    return e.sql("SELECT field, view, shard, count FROM system.parts WHERE table = 'areas'")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "events").sql("EXPLAIN SELECT count(*) FROM events WHERE value >= 5 AND NOT event_type = 'view'")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that aren't answered, and their codes."""
    e = regions(spark, sf_dir)
    e.sql("CREATE ROLE guest")
    e.sql("GRANT SELECT ON areas TO guest")
    rows = []
    for name, text, role in (
        ("role may read", "SELECT count(*) FROM areas", "guest"), ("role may not write", "TRUNCATE TABLE areas", "guest"), ("set operation", "SELECT name FROM areas UNION SELECT name FROM areas", None), ("no table", "SELECT count(*) FROM seas", None),
        ("too many rows", "SELECT name FROM areas SETTINGS max_result_rows = 2", None), ("too many deletes", "DELETE FROM areas WHERE size > 0 SETTINGS max_delete_records = 2", None), ("full", "INSERT INTO areas (size) VALUES (-1)", None),
    ):
        try:
            e.sql(text, role=role).collect()
            rows.append((name, "answered"))
        except Refused as x:
            rows.append((name, x.code))
    e.sql("REVOKE SELECT ON areas FROM guest")
    try:
        e.sql("SELECT count(*) FROM areas", role="guest")
    except Refused as x:
        rows.append(("revoked", x.code))
    rows += [("kill", str(e.sql("KILL QUERY 'nobody'").first()[0])), ("roles", ",".join(r[0] for r in e.sql("SHOW ROLES").collect()))]
    return spark.createDataFrame(rows, "what string, code string")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer in each output format."""
    e = engine(spark, sf_dir, "region")
    names = ("CSV", "CSVWithNames", "TSV", "TabSeparated", "TSVWithNames", "TabSeparatedWithNames", "JSON", "JSONCompact")
    return spark.createDataFrame([(f, e.render(f"SELECT r_regionkey, r_name FROM region WHERE r_name LIKE 'A%' ORDER BY r_regionkey LIMIT 3 FORMAT {f}")) for f in names], "format string, body string")


def bound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement through the client interface, with values bound by name."""
    from tallyhouse import dbapi

    with dbapi.connect(engine(spark, sf_dir, "events")) as c:
        rows = c.cursor().execute("SELECT event_type, count(*) AS n FROM events WHERE value >= %(low)s AND NOT event_type = %(but)s GROUP BY event_type", {"but": "view", "low": 20}).fetchall()
    return spark.createDataFrame(rows, "event_type string, n long")


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after compaction, from a backup of its store."""
    e = managed_events(spark, sf_dir)
    e.sql("DELETE FROM own WHERE status = 'P'")
    e.compact("own")
    e.store.vacuum("own")
    copy = folder(spark)
    e.backup(copy)
    e.sql("TRUNCATE TABLE own")
    return Engine(spark, copy).sql("SELECT status, count(*) AS n, sum(price) AS total FROM own GROUP BY status")


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in files, loaded in chunks in two goes; the last line of a record's field holds."""
    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE lastly (kind MUTEX, user UINT(32))")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 3000")
    lines = events.select("event_id", F.expr("event_id div 500").alias("file"), F.explode(F.array(F.concat_ws(" ", F.lit("kind"), "user_id", "event_type"), F.concat_ws(" ", F.lit("user"), "user_id", "user_id"))).alias("line"))
    path = f"{e.store.root}/incoming"
    for k in range(6):
        lines.where(F.col("file") == k).coalesce(1).sortWithinPartitions("event_id").select("line").write.text(f"{path}/{k}")
    # a load reads one folder's files by name; each of these folders holds one file
    for k in range(6):
        e.load_facts("lastly", f"{path}/{k}", f"part {k}", chunk_bytes=1)
        e.load_facts("lastly", f"{path}/{k}", f"part {k}", chunk_bytes=1)
    return e.sql("SELECT kind, count(*) AS n, sum(user) AS users FROM lastly GROUP BY kind")


def queued_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of many callers, acknowledged one by one; a bad row keeps out its own caller's rows only."""
    from tallyhouse.streaming.queue import WriteQueue

    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE notes (kind MUTEX, size UINT(8))")
    with WriteQueue(e, "notes", ["kind", "size"], within=0.5) as q:
        asked = [q.put([[f"k{i % 3}", i], [f"k{i % 2}", i + 1]]) for i in range(10)] + [q.put([["bad", 1], ["bad", 999]])]
    failed = sum(x.exception() is not None for x in asked)
    return e.sql("SELECT kind, count(*) AS n, sum(size) AS total FROM notes GROUP BY kind").withColumn("failed", F.lit(failed).cast("long"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that brings rows twice, in two runs, into a table that takes each key once."""
    from tallyhouse.streaming.live import ingest

    root = folder(spark)
    e = Engine(spark, root)
    e.sql("CREATE TABLE arrived (key MUTEX, kind MUTEX)")
    source = f"{root}/incoming"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 2000").selectExpr("cast(event_id as string) AS key", "event_type AS kind")
    for part in ("cast(key as int) < 1200", "cast(key as int) >= 800"):
        events.where(part).write.mode("append").parquet(source)
        ingest(e, "arrived", spark.readStream.schema(events.schema).parquet(source), f"{root}/progress", dedup="key", once=True).awaitTermination()
    return e.sql("SELECT kind, count(*) AS n FROM arrived GROUP BY kind")


def json_doubled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    docs = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 500").select("event_id", F.concat(F.lit('{"a": {"k": "in"}, "k": '), F.col("event_id"), F.lit(', "k": "later"}')).alias("doc"))
    e.attach("docs", docs, "event_id")
    return e.sql("SELECT event_id, JSONExtractInt(doc, 'k') AS a, JSONHas(doc, 'k') AS b, JSONExtractRaw(doc, 'k') AS c, JSONExtractString(doc, 'k') AS d FROM docs")


OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "member_of_repeats": (member_of_repeats, "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "multi_valued_cells": (multi_valued_cells, "SELECT user_id AS _record_id, list(DISTINCT event_type ORDER BY event_type) AS types, count(*) AS n_events FROM events GROUP BY user_id HAVING bool_or(event_type = 'view')"),
    "insert_values": (insert_values, "SELECT * FROM (VALUES (1::BIGINT, 'north', 10::BIGINT, ['cold']), (2, 'south', 26, ['warm', 'dry']), (3, 'west', 7, ['wet']), (9, NULL, 3, ['far']), (10, 'last', NULL, NULL)) t(_record_id, name, size, tags)"),
    "insert_overwrite": (insert_overwrite, "SELECT o_orderstatus AS status, count(*) AS n, sum(p) AS total, max(p) AS top FROM (SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS p FROM orders) WHERE p > 300000 GROUP BY 1"),
    "delete_ids": (delete_ids, "SELECT 2::BIGINT AS _record_id, 'south' AS name, 2::BIGINT AS gone"),
    "record_page": (record_page, "SELECT o_orderkey AS _record_id FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 50"),
    "alter_columns": (alter_columns, "SELECT * FROM (VALUES ('north', 10::BIGINT, -5::INTEGER), ('south', 25, NULL), ('west', 7, NULL)) t(name, size, rank)"),
    "rename_exchange": (rename_exchange, "SELECT * FROM (VALUES (3::BIGINT, 42::BIGINT), (0, 0)) t(n, total)"),
    "truncated": (truncated, "SELECT 1::BIGINT AS _record_id, 'first again' AS name, NULL::BIGINT AS size"),
    "drop_days": (drop_days, "WITH u AS (SELECT user_id, bool_or(event_type = 'click') AS a, bool_or(event_type = 'click' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-09') AS b, bool_or(event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-08') AS c, bool_or(event_type = 'click' AND CAST(ts AS DATE) >= DATE '2024-01-08') AS d FROM events GROUP BY 1) SELECT count(*) FILTER (a) AS n FROM u UNION ALL SELECT count(*) FILTER (b) FROM u UNION ALL SELECT count(*) FILTER (c) FROM u UNION ALL SELECT count(*) FILTER (NOT d) FROM u"),
    "databases": (databases, "SELECT * FROM (VALUES ('joined', 2::BIGINT, 3::BIGINT), ('own', 3, 6), ('default', 1, NULL), ('spare', 0, NULL)) t(what, n, total)"),
    "shown": (shown, "SELECT * FROM (VALUES ('table', 'areas', '3'), ('column', 'name', 'mutex'), ('column', 'size', 'int'), ('column', 'tags', 'set'), ('view', 'cold', 'SELECT name FROM areas WHERE tags = ''cold'''), ('create', 'areas', 'CREATE TABLE areas ( name MUTEX, size UINT(32), tags SET ) ENGINE = ''bitmap+columnar''')) t(what, name, of)"),
    "system_tables": (system_tables, "SELECT * FROM (VALUES ('areas', 'BASE TABLE'), ('cold', 'VIEW'), ('name', 'mutex'), ('size', 'int'), ('tags', 'set'), ('default', 'default')) t(name, of)"),
    "system_parts": (system_parts, "SELECT * FROM (VALUES ('name', 'standard', 0::BIGINT, 3::BIGINT), ('size', 'standard', 0, 3), ('tags', 'standard', 0, 3), ('name', 'standard', 1, 0), ('size', 'standard', 1, 1), ('tags', 'standard', 1, 0)) t(field, view, shard, count)"),
    "refused": (refused, "SELECT * FROM (VALUES ('role may read', 'answered'), ('role may not write', 'forbidden'), ('set operation', 'sql_union'), ('no table', 'unknown_table'), ('too many rows', 'result_too_large'), ('too many deletes', 'sql_delete_too_large'), ('full', 'value_out_of_range'), ('revoked', 'forbidden'), ('kill', '0'), ('roles', 'guest')) t(what, code)"),
    "explained": (explained, "SELECT unnest(['plan #0', 'Count events', '└── intersect', '    ├── value >= 5', '    └── not', '        └── event_type = ''view''', 'shape', 'Row', '└── count = count(*)']) AS explain"),
    "rendered": (rendered, "WITH r AS (SELECT r_regionkey AS k, r_name AS n FROM region WHERE r_name LIKE 'A%' ORDER BY 1 LIMIT 3), s AS (SELECT string_agg(k || ',' || n || chr(10), '' ORDER BY k) AS c, string_agg(k || chr(9) || n || chr(10), '' ORDER BY k) AS t, string_agg('{\"r_regionkey\": ' || k || ', \"r_name\": \"' || n || '\"}', ', ' ORDER BY k) AS o, string_agg('[' || k || ', \"' || n || '\"]', ', ' ORDER BY k) AS l, count(*) AS m, '{\"meta\": [{\"name\": \"r_regionkey\"}, {\"name\": \"r_name\"}], \"data\": [' AS h FROM r) SELECT unnest(['CSV', 'CSVWithNames', 'TSV', 'TabSeparated', 'TSVWithNames', 'TabSeparatedWithNames', 'JSON', 'JSONCompact']) AS format, unnest([c, 'r_regionkey,r_name' || chr(10) || c, t, t, 'r_regionkey' || chr(9) || 'r_name' || chr(10) || t, 'r_regionkey' || chr(9) || 'r_name' || chr(10) || t, h || o || '], \"rows\": ' || m || '}', h || l || '], \"rows\": ' || m || '}']) AS body FROM s"),
    "bound_values": (bound_values, "SELECT event_type, count(*) AS n FROM events WHERE value >= 20 AND event_type <> 'view' GROUP BY 1"),
    "restored": (restored, "SELECT o_orderstatus AS status, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"),
    "loaded": (loaded, "SELECT kind, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events WHERE event_id < 3000 GROUP BY 1) GROUP BY 1"),
    "queued_writes": (queued_writes, "WITH i AS (SELECT range AS i FROM range(10)), r AS (SELECT 'k' || (i % 3) AS kind, i AS size FROM i UNION ALL SELECT 'k' || (i % 2), i + 1 FROM i) SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS total, 1::BIGINT AS failed FROM r GROUP BY 1"),
    "stream_dedup": (stream_dedup, "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_id < 2000 GROUP BY 1"),
    "json_doubled_keys": (json_doubled_keys, "SELECT event_id, event_id AS a, 1 AS b, CAST(event_id AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS d FROM events WHERE event_id < 500"),
    "time_window": (time_window, "SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, count(*) AS n, bool_or(event_type = 'purchase' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-16') AS w FROM events GROUP BY user_id) WHERE w"),
    "set_group": (set_group, "WITH u AS (SELECT user_id, count(*) AS n, bool_or(event_type = 'click') AS c FROM events GROUP BY user_id), t AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type AS types, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM t JOIN u USING (user_id) WHERE c GROUP BY event_type"),
    "set_distinct": (set_distinct, "WITH u AS (SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type LIKE '%i%')), t AS (SELECT DISTINCT user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM u)), k AS (SELECT event_type, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, event_type LIMIT 2) SELECT (SELECT count(DISTINCT event_type) FROM t) AS n, (SELECT list(event_type ORDER BY n DESC, event_type) FROM k) AS top, (SELECT count(*) FROM u) AS users"),
    "view_segment": (view_segment, "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_totalprice < 400000 GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders WHERE NOT o_totalprice > 150000 GROUP BY 1"),
    "calls_top_n": (calls_top_n, "SELECT event_type, count(*) AS count FROM events WHERE NOT value < 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "calls_group_tuple": (calls_group_tuple, "SELECT o_orderpriority AS priority, CAST(date_trunc('year', o_orderdate) AS DATE) AS year, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000 GROUP BY 1, 2"),
    "insert_select": (insert_select, "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1, 2"),
    "delete_where": (delete_where, "SELECT o_orderstatus AS status, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders WHERE NOT (o_orderstatus = 'F' AND CAST(o_totalprice AS DECIMAL(12,2)) > 100000) GROUP BY 1"),
    "update_where": (update_where, "SELECT CASE WHEN hit THEN 'none' ELSE o_orderpriority END AS priority, count(*) AS n, sum(CASE WHEN hit THEN 1.5 ELSE price END) AS total FROM (SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderstatus = 'O' AND NOT CAST(o_totalprice AS DECIMAL(12,2)) > 50000 AS hit FROM orders) GROUP BY 1"),
    "fact_import": (fact_import, "WITH u AS (SELECT user_id, max(CAST(round(value * 100) AS BIGINT)) AS c, bool_or(event_type = 'view' AND CAST(ts AS DATE) >= DATE '2024-01-08') AS w FROM events GROUP BY user_id), t AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type AS kind, count(*) AS n, CAST(sum(c) AS DECIMAL(20,0)) * 0.01 AS total FROM t JOIN u USING (user_id) WHERE w GROUP BY 1"),
    "watch_snapshot": (watch_snapshot, "SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: statement(ours) for name, (ours, _) in SQL.items()} | {name: (lambda spark, sf_dir, f=f: plain(f(spark, sf_dir))) for name, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: theirs for name, (_, theirs) in SQL.items()} | {name: sql for name, (_, sql) in OTHER.items() if sql}
