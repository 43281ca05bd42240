"""Registered queries and the SQL that states their results.  Log operators run on the supplied tables: ``events`` is the event store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, alerts, detection, lookups, matching
from . import search_language as search

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _add(name: str, make, sql: str) -> None:
    QUERIES[name], ORACLES[name] = make, sql


EVENT_FIELDS = lambda: search.Fields({"user.name": F.col("user_id"), "event.action": F.col("event_type"), "event.severity": F.col("value"), "small": F.when(F.get_json_object("props", "$.k").try_cast("int") < 30, "yes")}, numbers=frozenset({"event.severity", "k"}), other=lambda n: F.get_json_object("props", f"$['{n}']"))

# Searches over events: name -> (query, the same as SQL).
_SEARCHES = {
    "kql_eq": ("event.action:PURCHASE", "lower(event_type) = 'purchase'"),
    "kql_and": ("event.action:purchase AND user.name:7", "lower(event_type) = 'purchase' AND user_id = 7"),
    "kql_or": ("event.action:purchase OR event.action:error", "event_type IN ('purchase', 'error')"),
    "kql_not": ("NOT event.action:purchase", "event_type <> 'purchase'"),
    "kql_group": ("(event.action:purchase OR event.action:error) event.severity:>50", "event_type IN ('purchase', 'error') AND value > 50"),
    "kql_value_group_or": ("event.action:(purchase OR click)", "event_type IN ('purchase', 'click')"),
    "kql_value_group_and": ("event.severity:(>20 AND <=60)", "value > 20 AND value <= 60"),
    "kql_wildcard": ("event.action:p*e", "lower(event_type) LIKE 'p%e'"),
    "kql_cmp": ("event.severity:>=75", "value >= 75"),
    "kql_num_eq": ("k:7.0", "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) = 7"),
    "kql_exists": ("k:* AND NOT missing:*", "json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.missing') IS NULL"),
    "kql_exists_some": ("_exists_:small", "TRY_CAST(json_extract_string(props, '$.k') AS INT) < 30"),
    "kql_json_field": ("k:>50 AND event.action:click", "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AND event_type = 'click'"),
}
for _name, (_text, _where) in _SEARCHES.items():
    _add(_name, lambda s, d, t=_text: _events(s, d).where(search.compile_query(t, EVENT_FIELDS())).select("event_id", "user_id", "event_type", "value"), f"SELECT event_id, user_id, event_type, value FROM events WHERE {_where}")

_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _full_text(query: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        docs = _table(s, d, "conversations").withColumn("tok", search.tokens_of(F.col("text")))
        fields = search.Fields({"role": F.col("role")}, lists={"word": F.col("tok")}, tokens=F.col("tok"))
        return docs.where(search.compile_query(query, fields)).select("conv_id", "turn")

    return run


for _name, _text, _where in (
    ("fts_word", "the", "list_contains(tok, 'the')"),
    ("fts_and", "the and", "list_contains(tok, 'the') AND list_contains(tok, 'and')"),
    ("fts_prefix", "th*", "len(list_filter(tok, lambda x: starts_with(x, 'th'))) > 0"),
    ("fts_phrase", "of-the", "contains(' ' || array_to_string(tok, ' ') || ' ', ' of the ')"),
    ("kql_list_eq", "word:THE", "list_contains(tok, 'the')"),
    ("kql_list_wildcard", "NOT word:t?e*", "len(list_filter(tok, lambda x: x LIKE 't_e%')) = 0"),
):
    _add(_name, _full_text(_text), f"SELECT conv_id, turn FROM (SELECT *, {_TOKENS} AS tok FROM conversations) WHERE {_where}")

_add("time_range", lambda s, d: aggregates.between(_events(s, d), "ts", dt.datetime(2024, 1, 5, tzinfo=dt.UTC), dt.datetime(2024, 1, 10, tzinfo=dt.UTC)).select("event_id"), "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
_add("search_page", lambda s, d: aggregates.page(_events(s, d).where(search.compile_query("event.action:error", EVENT_FIELDS())), [F.desc("ts"), "event_id"], 50, 20).select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20")
_add("count_query", lambda s, d: _events(s, d).where(search.compile_query("event.action:signup", EVENT_FIELDS())).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM events WHERE event_type = 'signup'")
_add("topk_terms", lambda s, d: aggregates.terms(_events(s, d), F.col("user_id"), 10), "SELECT user_id AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
_add("terms_list", lambda s, d: aggregates.terms(_table(s, d, "conversations"), search.tokens_of(F.col("text")), 25, is_list=True), f"SELECT w AS value, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS w FROM conversations) GROUP BY 1 ORDER BY n DESC, value LIMIT 25")
_add("histogram_filled", lambda s, d: aggregates.histogram(_events(s, d), F.col("ts"), F.to_timestamp(F.lit("2023-12-30")), F.to_timestamp(F.lit("2024-02-02")), 6 * 3600), """
SELECT b AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 137)) AS b) LEFT JOIN (
  SELECT floor((epoch(ts) - epoch(TIMESTAMP '2023-12-30')) / 21600)::BIGINT AS b, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2023-12-30' AND TIMESTAMP '2024-02-02' GROUP BY 1) USING (b)""")
_add("histogram_outcomes", lambda s, d: aggregates.by_outcome(_events(s, d), F.to_date("ts"), F.col("event_type"), {"failed": "error", "passed": "signup"}).withColumnRenamed("bucket", "day"), "SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'signup') AS passed FROM events GROUP BY 1")
_add("db_stats", lambda s, d: aggregates.extent(_events(s, d), "event_id"), "SELECT count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events")

def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with a field that some rows lack, a truth value and a list."""
    size = F.col("p_size")
    return _table(spark, sf_dir, "part").withColumns({"large": F.when(size > 30, size.cast("string")), "even": size % 2 == 0, "words": F.split("p_name", " ")})


# Predicates over part: name -> (field test, the same as SQL).
_MATCHES = {
    "match_contains": ({"p_name|contains": ["Green", "blue"]}, "contains(lower(p_name), 'green') OR contains(lower(p_name), 'blue')"),
    "match_startswith": ({"p_type|startswith": "promo"}, "starts_with(lower(p_type), 'promo')"),
    "match_endswith": ({"p_name|endswith": "Widget"}, "ends_with(lower(p_name), 'widget')"),
    "match_regex": ({"p_name|re": "^(red|small) .*(bolt|gizmo)$"}, "regexp_matches(p_name, '^(red|small) .*(bolt|gizmo)$', 'i')"),
    "match_glob": ({"p_brand": "brand#?2*"}, "p_brand ILIKE 'brand#_2%'"),
    "match_cs": ({"p_type|contains|cs": "ECONOMY"}, "contains(p_type, 'ECONOMY')"),
    "match_numeric": ({"p_size|gte": 20, "p_size|lt": 30}, "p_size >= 20 AND p_size < 30"),
    "match_exists": ({"large|exists": True}, "p_size > 30"),
    "match_null": ({"large": None}, "p_size <= 30"),
    "match_bool": ({"even": True}, "p_size % 2 = 0"),
    "match_all": ({"p_name|contains|all": ["red", "bolt"]}, "p_name ILIKE '%red%' AND p_name ILIKE '%bolt%'"),
    "match_not": ({"p_type|contains|not": ["promo", "small"]}, "NOT (coalesce(p_type ILIKE '%promo%', false) OR coalesce(p_type ILIKE '%small%', false))"),
    "match_not_missing": ({"large|not": "31"}, "p_size <= 30 OR p_size <> 31"),
    "match_int": ({"p_size": [7, 9]}, "p_size IN (7, 9)"),
    "match_int_of_double": ({"p_retailprice": [900, 1000]}, "p_retailprice IN (900, 1000)"),
    "match_list_field": ({"words|startswith": "b"}, "len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'b'))) > 0"),
    "match_any_of_maps": ([{"p_size|gt": 45}, {"p_type": "promo", "p_size|lte": 3}], "p_size > 45 OR (p_type = 'PROMO' AND p_size <= 3)"),
    "match_text": ("red", "contains(lower(p_name), 'red')"),
}
for _name, (_spec, _where) in _MATCHES.items():
    _add(_name, lambda s, d, x=_spec: _parts(s, d).where(matching.selection(x, F.col, frozenset({"words"}), ("p_name",))).select("p_partkey"), f"SELECT p_partkey FROM part WHERE {_where}")
_add("prefilter_dotted", lambda s, d: _events(s, d).where(matching.source_filter(F.concat(F.col("event_type"), F.lit(".web")), "ERROR")).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'error'")

# Conditions over lineitem: name -> (condition, the same as SQL).
_SEL = {"sel_a": {"l_quantity|gt": 40}, "sel_b": {"l_discount|gte": 0.05}, "sel_c": {"l_returnflag": "R"}, "filter": {"l_linenumber": 1}}
_A, _B, _C, _X = "l_quantity > 40", "l_discount >= 0.05", "l_returnflag = 'R'", "l_linenumber = 1"
for _name, _cond, _where in (
    ("cond_1_of", "1 of sel_*", f"{_A} OR {_B} OR {_C}"),
    ("cond_n_of", "2 of sel_*", f"({_A})::INT + ({_B})::INT + ({_C})::INT >= 2"),
    ("cond_all_of", "all of them", f"{_A} AND {_B} AND {_C} AND {_X}"),
    ("cond_filter", "(sel_a or sel_b) AND NOT filter", f"({_A} OR {_B}) AND NOT ({_X})"),
    ("cond_empty", "", f"{_A} AND {_B} AND {_C} AND {_X}"),
):
    _add(_name, lambda s, d, c=_cond: _table(s, d, "lineitem").where(matching.condition(c, {k: matching.selection(v, F.col) for k, v in _SEL.items()})).select("l_orderkey", "l_linenumber"), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_where}")

_DAY = 86400.0
_add("rolling_count", lambda s, d: detection.rolling_count(_events(s, d), "user_id", "ts", _DAY).select("event_id", "n"), "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
_add("rolling_distinct", lambda s, d: detection.rolling_distinct(_events(s, d), "user_id", "ts", "event_type", _DAY).select("event_id", "n"), "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")

_HITS = """
WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER w AS rn, lag(ts, 3) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT * FROM o WHERE first IS NOT NULL AND ts - first <= INTERVAL 12 HOUR),
h AS (
  SELECT user_id, rn, ts, ts AS last_fire, true AS fired FROM k WHERE (user_id, rn) IN (SELECT user_id, min(rn) FROM k GROUP BY user_id)
  UNION ALL
  SELECT user_id, rn, ts, CASE WHEN ts - last_fire >= INTERVAL 24 HOUR THEN ts ELSE last_fire END, ts - last_fire >= INTERVAL 24 HOUR
  FROM (SELECT k.user_id, k.rn, k.ts, h.last_fire, row_number() OVER (PARTITION BY k.user_id, h.rn ORDER BY k.rn) AS n FROM h JOIN k ON k.user_id = h.user_id AND k.rn >= h.rn + 4) WHERE n = 1)"""
_hits = lambda s, d: detection.threshold_hits(_events(s, d), "user_id", "ts", "event_id", 4, 12 * 3600, _DAY)
_add("threshold_hits", lambda s, d: _hits(s, d).select("user_id", F.col("rn").cast("long").alias("rn"), "fired"), _HITS + " SELECT user_id, rn, fired FROM h")
# The same with every key dealt to all tasks by slices of time, as keys of very many events are.
_add("threshold_hits_sliced", lambda s, d: detection.threshold_hits(_events(s, d), "user_id", "ts", "event_id", 4, 12 * 3600, _DAY, hot_rows=0).select("user_id", F.col("rn").cast("long").alias("rn"), "fired"), _HITS + " SELECT user_id, rn, fired FROM h")
_SESSIONS = """
, g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, rn) AS before FROM h),
n AS (SELECT *, sum((before IS NULL OR ts - before > INTERVAL 24 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts, rn) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, sum(CASE WHEN fired THEN 4 ELSE 1 END)::BIGINT AS count FROM n GROUP BY user_id, s"""
_micros = lambda df: df.select("user_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "count")
_add("threshold_alerts", lambda s, d: _micros(detection.threshold_alerts(_events(s, d), "user_id", "ts", "event_id", 4, 12 * 3600, _DAY)), _HITS + _SESSIONS)
_add("alert_sessions", lambda s, d: _micros(detection.alert_sessions(_events(s, d).where("event_type = 'error'").withColumnRenamed("event_id", "rn"), "user_id", "ts", _DAY, F.lit(1))), """
WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'error'),
n AS (SELECT *, sum((before IS NULL OR ts - before > INTERVAL 24 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS count FROM n GROUP BY user_id, s""")
_stages = lambda: [(F.col("event_type") == "error", 2), (F.col("event_type") == "purchase", 1)]
_sequence = lambda s, d, exact: detection.sequence_alerts(_events(s, d), "user_id", "ts", "event_id", _stages(), 3 * _DAY, exact).select("user_id", F.unix_micros("ts").alias("us"), F.unix_micros("started").alias("started"), "n")
# The fold, one event after the other: s is the stage that is awaited, c its counter, n the run's events, b its start.
_RUNS = """
WITH RECURSIVE e AS (
  SELECT user_id, epoch_us(ts) AS us, event_type = 'error' AS first, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'purchase')),
r AS (
  SELECT user_id, 0::BIGINT AS i, 0 AS s, 0 AS c, 0::BIGINT AS n, NULL::BIGINT AS b, NULL::BIGINT AS us, NULL::BIGINT AS started, NULL::BIGINT AS done FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, i, CASE WHEN own AND s = 1 THEN 0 WHEN hit AND c + 1 >= CASE WHEN own AND s = 1 THEN 1 ELSE 2 END THEN 1 ELSE s END,
         CASE WHEN NOT hit THEN c WHEN (own AND s = 1) OR c + 1 >= 2 THEN 0 ELSE c + 1 END,
         CASE WHEN own AND s = 1 THEN 0 WHEN hit THEN n + 1 ELSE n END, CASE WHEN own AND s = 1 THEN NULL WHEN hit THEN coalesce(b, us) ELSE b END,
         us, CASE WHEN own AND s = 1 THEN b END, CASE WHEN own AND s = 1 THEN n + 1 END
  FROM (SELECT user_id, i, us, s, c, n, b, first = (s = 0) AS own, first = (s = 0) OR (first AND {exact}) AS hit FROM (
    SELECT e.user_id, e.i, e.us, e.first, CASE WHEN old THEN 0 ELSE s END AS s, CASE WHEN old THEN 0 ELSE c END AS c, CASE WHEN old THEN 0 ELSE n END AS n, CASE WHEN old THEN NULL ELSE b END AS b
    FROM (SELECT e.*, r.s, r.c, r.n, r.b, coalesce(e.us - r.b > 259200000000, false) AS old FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) AS e)))
SELECT user_id, us, started, done AS n FROM r WHERE done IS NOT NULL"""
_add("sequence_alerts", lambda s, d: _sequence(s, d, True), _RUNS.format(exact="true"))
_add("sequence_alerts_plain", lambda s, d: _sequence(s, d, False), _RUNS.format(exact="false"))
_add("threshold_distinct", lambda s, d: detection.threshold_hits(_events(s, d), "user_id", "ts", "event_id", 4, 2 * _DAY, _DAY, F.col("event_type")).select("user_id", F.col("rn").cast("long").alias("rn"), "fired"), """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS rn, MAP([]::VARCHAR[], []::BIGINT[]) AS seen, NULL::BIGINT AS last, false AS hit, false AS fired FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, rn, CASE WHEN done THEN MAP([]::VARCHAR[], []::BIGINT[]) ELSE m END, CASE WHEN done AND (last IS NULL OR us - last >= 86400000000) THEN us ELSE last END, done, done AND (last IS NULL OR us - last >= 86400000000)
  FROM (SELECT *, cardinality(m) >= 4 AS done FROM (
    SELECT e.user_id, e.rn, e.us, r.last, map_from_entries(list_append(list_filter(map_entries(r.seen), lambda x: x.key <> e.v AND x.value >= e.us - 172800000000), {'key': e.v, 'value': e.us})) AS m
    FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))
SELECT user_id, rn, fired FROM r WHERE hit""")

_add("join_asset", lambda s, d: lookups.by_key(_table(s, d, "supplier"), _table(s, d, "nation"), "s_nationkey", "n_nationkey", ["n_name"]).select("s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")


def _bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 50_000, "small", 1), (40_000, 150_000, "middle", 2), (100_000, 10_000_000, "large", 3), (120_000, 121_000, "special", 4)], "lo long, hi long, band string, ord int")


_BANDS = "(VALUES (0, 50000, 'small', 1), (40000, 150000, 'middle', 2), (100000, 10000000, 'large', 3), (120000, 121000, 'special', 4)) AS b(lo, hi, band, ord)"
_orders = lambda s, d: _table(s, d, "orders").withColumn("price", F.floor("o_totalprice"))
for _name, _order, _longest in (("join_zone_range", "ord", False), ("join_longest_prefix", "hi - lo, ord", True)):
    _add(_name, lambda s, d, x=_longest: lookups.by_range(_orders(s, d), _bands(s), "price", "lo", "hi", "band", "ord", "o_orderkey", 1 << 20, x), f"SELECT o_orderkey, (SELECT arg_min(band, row(r, ord)) FROM (SELECT *, {'hi - lo' if _longest else 'ord'} AS r FROM {_BANDS}) WHERE floor(o_totalprice) BETWEEN lo AND hi) AS band FROM orders")
_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_LISTED = ("example.com", "site1.example.org", "example.org", "test")
_add("join_suffix_domain", lambda s, d: lookups.by_suffix(_table(s, d, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)), s.createDataFrame([(x,) for x in _LISTED], "indicator string"), "host", "indicator", "page_id"), f"""
WITH p AS (SELECT page_id, string_split(lower({_HOST}), '.') AS l FROM pages),
x AS (SELECT page_id, i, array_to_string(l[i:], '.') AS s FROM (SELECT page_id, l, unnest(range(1, len(l))) AS i FROM p)),
m AS (SELECT page_id, arg_min(s, i) AS indicator FROM x WHERE s IN {_LISTED} GROUP BY page_id)
SELECT page_id, indicator FROM pages LEFT JOIN m USING (page_id)""")
_add("dedup_events", lambda s, d: aggregates.first_by_id(_events(s, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id"), "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
_add("agg_open_alerts", lambda s, d: alerts.counts(_table(s, d, "orders").where("o_orderstatus != 'F'"), ("o_orderstatus", "o_orderpriority")), """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'F')
SELECT 'o_orderstatus' AS what, o_orderstatus AS key, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM o GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*) FROM o UNION ALL SELECT 'open', NULL, count(*) FROM o""")
_add("agg_tactic_distinct", lambda s, d: alerts.distinct_by(_events(s, d), F.split("event_type", "i"), "user_id"), "SELECT key, count(DISTINCT user_id) AS n FROM (SELECT user_id, unnest(string_split(event_type, 'i')) AS key FROM events) GROUP BY 1")
_add("parse_url", lambda s, d: _table(s, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path")), f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
_add("registered_domain", lambda s, d: _table(s, d, "pages").select("page_id", scalar.registered_domain(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("domain")), f"SELECT page_id, CASE WHEN len(l) >= 2 THEN array_to_string(l[-2:], '.') END AS domain FROM (SELECT page_id, string_split(lower({_HOST}), '.') AS l FROM pages)")
_add("parse_json_flat", lambda s, d: _events(s, d).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")), "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_add("parse_kv", lambda s, d: _events(s, d).select("event_id", scalar.key_values(F.concat(F.lit("type="), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" user=\"last one\""))).alias("m")).select("event_id", F.col("m")["type"].alias("type"), F.col("m")["user"].alias("user")), "SELECT event_id, event_type AS type, 'last one' AS user FROM events")
_add("parse_ts", lambda s, d: _events(s, d).select("event_id", F.unix_seconds(scalar.timestamp(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000"), 2024)).alias("s")), "SELECT event_id, floor(epoch(ts))::BIGINT AS s FROM events")
_add("ecs_canon", lambda s, d: _table(s, d, "part").select("p_partkey", scalar.canonical(F.col("p_type"), {"economy": "cheap"}).alias("kind")), "SELECT p_partkey, CASE WHEN c = 'economy' THEN 'cheap' ELSE c END AS kind FROM (SELECT p_partkey, translate(lower(trim(p_type)), '- ', '__') AS c FROM part)")
_add("severity_boost", lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.boosted_severity(F.col("l_quantity").cast("int") * 2, F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "high"), F.col("l_linenumber") == 3).cast("int").alias("score")), """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN greatest(r, 75) ELSE r END AS score FROM (
  SELECT *, least(q + CASE WHEN q <= 10 THEN 0 WHEN l_returnflag = 'R' THEN 20 WHEN l_returnflag = 'A' THEN 10 ELSE 0 END, 100) AS r FROM (SELECT *, l_quantity::INT * 2 AS q FROM lineitem))""")

from . import log_queries  # noqa: E402 - it adds to the two tables

QUERIES |= log_queries.QUERIES
ORACLES |= log_queries.ORACLES
ORACLES["rule_pack_alerts"] = log_queries.pack_sql(ORACLES["threshold_alerts"], ORACLES["sequence_alerts"])
