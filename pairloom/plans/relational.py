"""General relational queries: each is Spark SQL over the tables of a folder, and the SQL another engine gives for it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.quantiles import quantile_columns
from pairloom.sources.tables import file_stream, read, shared_path, table, write
from pairloom.streaming.jobs import write_each_batch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAMES = re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def pair(name: str, sql: str, other: str | None = None) -> None:
    """Register a query; {table} stands for a table. `other` is the SQL of the check where it is written differently."""
    used = sorted(set(_NAMES.findall(sql)))

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, folder, t) for t in used})

    QUERIES[name] = run
    ORACLE_SQL[name] = _NAMES.sub(r"\1", other or sql)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


for _t in TABLES:
    if _t != "embeddings":
        pair(f"b01_scan_{_t}", f"SELECT * FROM {{{_t}}}")
pair("b01_scan_embeddings", "SELECT vec_id, label, p + 1 AS place, CAST(v AS DOUBLE) AS value FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS p, v", "SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS place, CAST(unnest(embedding) AS DOUBLE) AS value FROM {embeddings}")

pair("b02_project_filter", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), 'open') AS status, greatest(o_totalprice, 1000.0D) AS g, least(o_totalprice, 1000.0D) AS l FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 400000 AND o_orderpriority <> '5-LOW'",
     "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), 'open') AS status, greatest(o_totalprice, 1000.0) AS g, least(o_totalprice, 1000.0) AS l FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 400000 AND o_orderpriority <> '5-LOW'")
pair("b03_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ring' OR p_name ILIKE 'RED%'")
pair("b04_inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
pair("b04_left_join", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
pair("b04_right_join", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_totalprice > 300000")
pair("b04_full_join", "SELECT c_custkey, s_suppkey FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey + 1450")
pair("b05_semi_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
pair("b05_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000)")
pair("b05_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
pair("b05_not_in", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
pair("b06_cross", "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}")
pair("b06_theta", "SELECT a.s_suppkey AS lo, b.s_suppkey AS hi FROM {supplier} a JOIN {supplier} b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey")
pair("b06_theta_range", "SELECT a.n_name AS lo, b.n_name AS hi FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey")
pair("b07_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top FROM {customer}")
pair("b07_lateral_top1", "SELECT c_custkey, t.o_orderkey FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t",  # Spark keeps the order per customer only if the subquery selects all it is ordered by
     "SELECT c_custkey, t.o_orderkey FROM {customer}, LATERAL (SELECT o_orderkey FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
pair("b08_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty, count(*) FILTER (WHERE l_discount > 0.05) AS cut FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
pair("b08_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus")
for _n, _g in (("grouping_sets", "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"), ("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)")):
    pair(f"b09_{_n}", f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM {{orders}} GROUP BY {_g}")


@query("b10_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
def b10(spark, d):
    """The sketch, held against the exact count: near says whether it is within three of its standard errors."""
    pairs = table(spark, d, "lineitem").select("l_returnflag", "l_partkey").distinct()  # a sketch is the same over values that are repeated; beside a DISTINCT of raw rows Spark would shuffle one for every pair
    counts = pairs.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("sketch"), F.count("l_partkey").alias("parts"))
    return counts.select("l_returnflag", "parts", (F.abs(F.col("sketch") - F.col("parts")) <= 3 * 0.02 * F.col("parts")).alias("near"))


@query("b11_quantile", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def b11(spark, d):
    found = quantile_columns(table(spark, d, "events"), ("event_type",), "value", {"q1": 0.25, "q2": 0.5, "p95": 0.95})
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "q2", "p95")})


pair("b12_bool_max_by", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS alls, bool_or(o_totalprice > 400000) AS anys, max_by(o_orderkey, o_orderkey) AS last_key, array_join(array_sort(collect_set(o_orderpriority)), ',') AS prios FROM {orders} GROUP BY o_orderstatus",
     "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS alls, bool_or(o_totalprice > 400000) AS anys, arg_max(o_orderkey, o_orderkey) AS last_key, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS prios FROM {orders} GROUP BY o_orderstatus")
pair("b12_mode", "SELECT event_type, mode() WITHIN GROUP (ORDER BY user_id) AS user_id FROM {events} GROUP BY event_type", "SELECT event_type, min(user_id) AS user_id FROM (SELECT event_type, user_id, count(*) AS n, max(count(*)) OVER (PARTITION BY event_type) AS top FROM {events} GROUP BY event_type, user_id) WHERE n = top GROUP BY event_type, n")


@query("b13_pivot", "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS \"F\", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS \"O\", round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS \"P\" FROM orders GROUP BY 1")
def b13(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2))


pair("b13_unpivot", "SELECT c_custkey, what, v FROM (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nation FROM {customer}) UNPIVOT (v FOR what IN (c_acctbal, c_nation))")
pair("b14_ranks", "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
pair("b15_percent_rank", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)")
pair("b16_offsets", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after2, first_value(value) OVER w AS first, last_value(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(value, 2) OVER w AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
pair("b17_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS around, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_n FROM {events}")
pair("b18_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
pair("b19_top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 3")
for _n, _s in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    pair(f"b20_{_n}", f"SELECT c_nationkey AS k FROM {{customer}} {_s} SELECT s_nationkey FROM {{supplier}} WHERE s_acctbal > 5000")
pair("b21_strings", "SELECT c_custkey, substring(c_name, 1, 8) AS s, upper(c_mktsegment) AS u, lower(c_name) AS lo, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '#', '-') AS r, lpad(CAST(c_custkey AS STRING), 8, '0') AS p, reverse(c_name) AS rev, concat_ws('|', c_name, c_mktsegment) AS c, CAST(instr(c_name, '#') AS BIGINT) AS i, trim(concat('  ', c_name, ' ')) AS t, split_part(c_name, '#', 2) AS sp, CAST(levenshtein(c_mktsegment, 'MACHINERY') AS BIGINT) AS lev, md5(c_name) AS h FROM {customer}",
     "SELECT c_custkey, substring(c_name, 1, 8) AS s, upper(c_mktsegment) AS u, lower(c_name) AS lo, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '#', '-') AS r, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p, reverse(c_name) AS rev, concat_ws('|', c_name, c_mktsegment) AS c, CAST(instr(c_name, '#') AS BIGINT) AS i, trim(concat('  ', c_name, ' ')) AS t, split_part(c_name, '#', 2) AS sp, CAST(levenshtein(c_mktsegment, 'MACHINERY') AS BIGINT) AS lev, md5(c_name) AS h FROM {customer}")
pair("b22_regex", r"SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '_') AS masked, p_name RLIKE '^(red|blue)' AS starts FROM {part}",
     r"SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS num, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, regexp_matches(p_name, '^(red|blue)') AS starts FROM {part}")
pair("b23_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS dd, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS dy, last_day(o_orderdate) AS ld, o_orderdate + INTERVAL '10' DAY AS later, CAST(datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS BIGINT) AS since FROM {orders}",
     "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, last_day(o_orderdate) AS ld, o_orderdate + INTERVAL '10' DAY AS later, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS since FROM {orders}")
pair("b24_day_of_week", "SELECT event_id, CAST(dayofweek(ts) - 1 AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS h FROM {events}", "SELECT event_id, dayofweek(ts) AS dow, hour(ts) AS h FROM {events}")
pair("b25_buckets", "SELECT window.start AS start, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '6 hours'), event_type",
     "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM {events} GROUP BY ALL")
pair("b25_sliding_buckets", "SELECT window.start AS start, count(*) AS n FROM {events} GROUP BY window(ts, '2 hours', '1 hour')",
     "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start FROM {events}) GROUP BY 1")
pair("b26_math", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(exp(c_nationkey / 10.0D), 6) AS e, round(ln(c_custkey + 1), 6) AS l, round(log10(c_custkey + 1), 6) AS lg, round(pow(c_nationkey, 2), 6) AS p, round(sqrt(c_custkey), 6) AS s, CAST(sign(c_acctbal) AS INT) AS sg, round(atan(c_acctbal), 6) AS t FROM {customer}",
     "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(exp(c_nationkey / 10.0::DOUBLE), 6) AS e, round(ln(c_custkey + 1), 6) AS l, round(log10(c_custkey + 1), 6) AS lg, round(pow(c_nationkey, 2), 6) AS p, round(sqrt(c_custkey), 6) AS s, CAST(sign(c_acctbal) AS INT) AS sg, round(atan(c_acctbal), 6) AS t FROM {customer}")
pair("b27_decimal", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM {orders} GROUP BY o_orderstatus")
pair("b28_division", "SELECT o_orderkey, o_orderkey div 7 AS d, o_orderkey % 7 AS m, round(o_orderkey / 7, 6) AS q FROM {orders}", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m, round(o_orderkey / 7, 6) AS q FROM {orders}")
pair("b29_arrays", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, array_max(embedding) AS top, round(aggregate(zip_with(embedding, embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (a, x) -> a + x), 4) AS dot FROM {embeddings}",
     "SELECT vec_id, len(embedding) AS n, list_max(embedding) AS top, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS dot FROM {embeddings}")
pair("b29_explode", "SELECT vec_id, CAST(pos AS BIGINT) AS pos, x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM {embeddings}")
pair("b30_maps", "SELECT o_orderkey, map('F', 'done', 'O', 'open', 'P', 'part')[o_orderstatus] AS status FROM {orders}", "SELECT o_orderkey, map(['F', 'O', 'P'], ['done', 'open', 'part'])[o_orderstatus] AS status FROM {orders}")
pair("b31_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM {events}")
pair("b32_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '1' DAY THEN 0 ELSE 1 END AS new FROM {events}),
    s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM s GROUP BY user_id, session""")
pair("b33_width_bucket", "SELECT CAST(width_bucket(value, 0, 100, 20) AS INT) AS b, count(*) AS n FROM {events} GROUP BY 1", "SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE floor(value / 5) + 1 END AS INTEGER) AS b, count(*) AS n FROM {events} GROUP BY 1")
pair("b34_recursive", "WITH RECURSIVE t(k, depth, balance) AS (SELECT c_custkey, 0, c_acctbal FROM {customer} WHERE c_custkey = 1 UNION ALL SELECT /*+ MERGE(c) */ c.c_custkey, t.depth + 1, t.balance + c.c_acctbal FROM t JOIN {customer} c ON c.c_custkey div 2 = t.k AND c.c_custkey > 1) SELECT k, depth, round(balance, 4) AS balance FROM t LIMIT ALL",  # a level would broadcast the whole table through the driver; LIMIT ALL lifts the limit of a million rows
     "WITH RECURSIVE t(k, depth, balance) AS (SELECT c_custkey, 0, c_acctbal FROM {customer} WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, t.depth + 1, t.balance + c.c_acctbal FROM t JOIN {customer} c ON c.c_custkey // 2 = t.k AND c.c_custkey > 1) SELECT k, depth, round(balance, 4) AS balance FROM t")
pair("b35_qualify_as_subquery", "SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM {supplier}) WHERE rn = 1", "SELECT s_nationkey, s_suppkey FROM {supplier} QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1")


def _round_trip(name: str, format: str) -> None:  # noqa: A002
    @query(f"b36_{name}_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
    def run(spark, d, format=format):  # noqa: A002
        df, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), shared_path(spark, "sink")
        write(df, path, format)
        return read(spark, path, format, df.schema)


for _f in ("parquet", "orc", "csv", "json"):
    _round_trip(_f, _f)


@query("b36_partitioned_sink", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def b36p(spark, d):
    path = shared_path(spark, "sink")
    write(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=("o_orderstatus",))
    return read(spark, path, schema="o_orderkey bigint, o_orderstatus string").where("o_orderstatus = 'F'")


@query("b36_foreach_batch", "SELECT event_id, user_id FROM events")
def b36f(spark, d):
    path = shared_path(spark, "sink")
    write_each_batch(file_stream(spark, d, "events").select("event_id", "user_id"), path)
    return read(spark, path, schema="event_id bigint, user_id bigint, batch int").drop("batch")


_DOUBLED = "SELECT event_id, value * 2 AS doubled FROM events"


@query("udf_python", _DOUBLED)
def udf_python(spark, d):
    return table(spark, d, "events").select("event_id", F.udf(lambda v: v * 2, "double")("value").alias("doubled"))


@query("udf_pandas", _DOUBLED)
def udf_pandas(spark, d):
    def twice(v: pd.Series) -> pd.Series:
        return v * 2

    return table(spark, d, "events").select("event_id", F.pandas_udf(twice, "double")("value").alias("doubled"))


@query("udaf_pandas", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def udaf_pandas(spark, d):
    def mean(v: pd.Series) -> float:
        return float(v.mean())

    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.pandas_udf(mean, "double")("value"), 6).alias("mean"))


@query("udaf_pandas_window", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def udaf_window(spark, d):
    def mean(v: pd.Series) -> float:
        return float(v.mean())

    frame = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.pandas_udf(mean, "double")("value").over(frame), 6).alias("mean"))


@query("udf_grouped_map", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS demeaned FROM events")
def udf_grouped(spark, d):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": pdf.event_id, "demeaned": pdf.value - pdf.value.mean()})

    return table(spark, d, "events").select("event_type", "event_id", "value").groupBy("event_type").applyInPandas(one, "event_id long, demeaned double").withColumn("demeaned", F.round("demeaned", 6))


@query("udf_cogroup", "SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def udf_cogroup(spark, d):
    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a, b = table(spark, d, "customer").select("c_nationkey", "c_custkey"), table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return a.groupBy("c_nationkey").cogroup(b.groupBy("s_nationkey")).applyInPandas(both, "k int, customers long, suppliers long").where("customers > 0")


@query("udf_map_arrow", "SELECT event_id FROM events WHERE value > 50")
def udf_map_arrow(spark, d):
    def keep(batches):
        import pyarrow.compute as pc

        for b in batches:
            yield b.filter(pc.greater(b["value"], 50)).select(["event_id"])

    return table(spark, d, "events").select("event_id", "value").mapInArrow(keep, "event_id long")


@query("udf_map_pandas", "SELECT event_id, CAST(hour(ts) AS BIGINT) AS h FROM events")
def udf_map_pandas(spark, d):
    def hours(batches):
        for b in batches:
            yield pd.DataFrame({"event_id": b.event_id, "h": b.ts.dt.hour})

    return table(spark, d, "events").select("event_id", "ts").mapInPandas(hours, "event_id long, h long")


@query("udtf_python", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_python(spark, d):
    class Words:
        def eval(self, key: int, name: str):
            for w in name.split(" "):
                yield key, w

    words = F.udtf(Words, returnType="p_partkey bigint, word string")
    part = table(spark, d, "part").select("p_partkey", "p_name")
    spark.udtf.register("pairloom_words", words)
    return spark.sql("SELECT w.* FROM {part}, LATERAL pairloom_words(p_partkey, p_name) w", part=part)
