"""Queries of product analytics: counts, ratios, funnels, histograms, lookups and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import records as R
from ..operators import sessions as V
from .registry import query, table

TYPES = ["click", "error", "purchase", "refund", "signup", "view"]


def listed(spark: SparkSession, name: str, members: list) -> DataFrame:
    """A small fixed list as a frame."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in members])).alias(name))


def last_ts(events: DataFrame):
    """The as-of instant of a query: the latest event's."""
    return events.agg(F.max("ts").alias("m")).scalar()


@query("SELECT event_type, COALESCE(n, 0) AS n FROM (SELECT unnest(['click','error','purchase','refund','signup','view']) AS event_type) d LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e USING (event_type)")
def events_by_type_zero_filled(spark, sf):
    return A.zero_filled(listed(spark, "event_type", TYPES), A.counted(table(spark, sf, "events"), "event_type"), ["event_type"], ["n"])


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT user_id) FROM events) AS users")
def table_counts(spark, sf):
    customers, orders, users = (table(spark, sf, "customer").agg(F.count("*").alias("n")), table(spark, sf, "orders").agg(F.count("*").alias("n")), table(spark, sf, "events").agg(F.countDistinct("user_id").alias("n")))
    return spark.range(1).select(customers.scalar().alias("customers"), orders.scalar().alias("orders"), users.scalar().alias("users"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts)::DATE - 13 FROM events)")
def filtered_projected_scan(spark, sf):
    events = table(spark, sf, "events")
    return events.filter(F.col("ts") >= F.date_sub(F.to_date(last_ts(events)), 13).cast("timestamp_ntz")).select("event_id", "ts")


@query("SELECT o_orderkey, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey")
def point_lookup(spark, sf):
    ids = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select("c_custkey")
    return table(spark, sf, "orders").join(ids, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_custkey").isNotNull().alias("known"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS pages, round(sum(l_extendedprice), 2) AS bytes, round(avg(l_discount), 6) AS avg_duration FROM lineitem GROUP BY ALL")
def status_multi_agg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("pages"), F.round(F.sum("l_extendedprice"), 2).alias("bytes"), F.round(F.avg("l_discount"), 6).alias("avg_duration"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def filtered_group_counts(spark, sf):
    return A.counted(table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F"), "o_orderpriority")


def rated(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("*", F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"))


@query("SELECT round(avg(CAST(substr(o_orderpriority, 1, 1) AS INT)), 6) AS avg_rating, count(*) AS reviews FROM orders")
def rating_summary(spark, sf):
    return rated(spark, sf).agg(F.round(F.avg("rating"), 6).alias("avg_rating"), F.count("*").alias("reviews"))


@query("SELECT r AS rating, count(o_orderkey) AS n FROM (SELECT unnest([7,6,5,4,3,2,1]) AS r) d LEFT JOIN orders ON CAST(substr(o_orderpriority, 1, 1) AS INT) = r GROUP BY 1")
def rating_distribution(spark, sf):
    return A.zero_filled(listed(spark, "rating", [7, 6, 5, 4, 3, 2, 1]), A.counted(rated(spark, sf), "rating"), ["rating"], ["n"])


@query("SELECT o_orderstatus, round(avg(CAST(substr(o_orderpriority, 1, 1) AS INT)), 6) AS avg_rating, count(*) AS n FROM orders GROUP BY 1")
def rating_by_tool(spark, sf):
    return rated(spark, sf).groupBy("o_orderstatus").agg(F.round(F.avg("rating"), 6).alias("avg_rating"), F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderpriority END AS place, count(*) AS n FROM orders GROUP BY 1")
def nullable_group_counts(spark, sf):
    return A.counted(places(spark, sf), "place")


def places(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 7
    return table(spark, sf, "orders").select(F.when(k == 0, None).when(k == 1, "").otherwise(F.col("o_orderpriority")).alias("place"))


@query("SELECT o_orderpriority AS place, count(*) AS n FROM orders WHERE o_orderkey % 7 > 1 GROUP BY 1 ORDER BY n DESC, place LIMIT 3")
def top_named_groups(spark, sf):
    return A.top_groups(A.without_blank(A.counted(places(spark, sf), "place"), "place"), "place", 3)


@query("""WITH g AS (SELECT o_orderstatus, avg(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END) AS mean, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)
SELECT round(CASE WHEN sum(n) > 0 THEN sum(COALESCE(mean, 0) * n) / greatest(sum(n), 1) END, 4) AS weighted_mean FROM g""")
def weighted_duration(spark, sf):
    orders = table(spark, sf, "orders").withColumn("ms", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")))
    return A.weighted_mean(orders, "ms", "o_orderstatus", ["F", "O"]).select(F.round("weighted_mean", 4).alias("weighted_mean"))


@query("SELECT o_orderpriority, round(CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'P')) > 0 THEN count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'P')) END, 6) AS rate FROM orders GROUP BY 1")
def success_rate_by_dim(spark, sf):
    tab = A.cross_tab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", {"ok": ["F"], "ended": ["F", "P"]})
    return tab.select("o_orderpriority", F.round(S.ratio(F.col("ok"), F.col("ended")), 6).alias("rate"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS opens, count(*) FILTER (event_type IN ('signup', 'click')) AS uploads, count(*) FILTER (event_type IN ('purchase', 'error')) AS made FROM events GROUP BY 1")
def action_crosstab(spark, sf):
    return A.cross_tab(table(spark, sf, "events"), "user_id", "event_type", {"opens": ["view"], "uploads": ["signup", "click"], "made": ["purchase", "error"]})


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1)
SELECT *, round(CASE WHEN view > 0 THEN least(1.0, click / view) END, 6) AS click_rate, round(CASE WHEN click > 0 THEN least(1.0, purchase / click) END, 6) AS purchase_rate FROM c""")
def funnel_view_click_purchase(spark, sf):
    out = A.funnel(table(spark, sf, "events"), "user_id", "event_type", ["view", "click", "purchase"])
    return out.select("user_id", "view", "click", "purchase", F.round("click_rate", 6).alias("click_rate"), F.round("purchase_rate", 6).alias("purchase_rate"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT max(c) FROM (SELECT count(*) AS c FROM events GROUP BY event_type)), 6) AS share FROM events GROUP BY 1")
def max_normalised_share(spark, sf):
    return A.share_of_largest(A.counted(table(spark, sf, "events"), "event_type"), "n").select("event_type", "n", F.round("share", 6).alias("share"))


@query("SELECT sum(n)::BIGINT AS total, count(*) AS groups FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def regrouped_totals(spark, sf):
    return A.counted(table(spark, sf, "events"), "user_id", "event_type").agg(F.sum("n").alias("total"), F.count("*").alias("groups"))


@query("""WITH m AS (SELECT max(ts)::DATE + 1 AS d FROM events), s AS (SELECT (d - i::INT)::DATE AS day FROM m, range(14) r(i))
SELECT day::VARCHAR AS day, count(event_id) AS n FROM s LEFT JOIN events ON ts::DATE = day GROUP BY 1""")
def daily_histogram_14d(spark, sf):
    events = table(spark, sf, "events")
    return A.daily_histogram(events, "ts", F.date_add(F.to_date(last_ts(events)), 1), 14).withColumn("day", F.col("day").cast("string"))


SESSIONS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, k, min(ts) AS started, max(ts) AS last_hit, count(*) AS hits, arg_min(event_type, ts) AS entry FROM n GROUP BY 1, 2)"""


def visits(spark, sf) -> DataFrame:
    return V.sessions(table(spark, sf, "events"), "user_id", "ts", firsts={"entry": "event_type"})


@query(f"WITH {SESSIONS} SELECT user_id, started, last_hit, hits, entry FROM s")
def sessions_30m(spark, sf):
    return visits(spark, sf)


@query(f"WITH {SESSIONS} SELECT user_id, min(started) AS first_seen, max(started) AS last_seen, count(*) AS visit_count FROM s GROUP BY 1")
def derived_visitors(spark, sf):
    return V.visitors(visits(spark, sf), "user_id")


@query(f"WITH {SESSIONS}, v AS (SELECT user_id, min(started) AS f, max(started) AS l FROM s GROUP BY 1), m AS (SELECT max(ts) AS t FROM events) SELECT count(*) FILTER (l >= t - INTERVAL 7 DAY) AS active, count(*) FILTER (f >= date_trunc('day', t)) AS new_today FROM v, m")
def active_visitors(spark, sf):
    last = last_ts(table(spark, sf, "events"))
    own = V.visitors(visits(spark, sf), "user_id")
    return own.agg(F.count(F.when(F.col("last_seen") >= last - F.expr("interval 7 days"), 1)).alias("active"), F.count(F.when(F.col("first_seen") >= F.to_date(last).cast("timestamp_ntz"), 1)).alias("new_today"))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, ts, k, ts AS w, 1 AS n FROM o WHERE k = 1
UNION ALL SELECT o.event_id, o.user_id, o.ts, o.k, CASE WHEN r.w + INTERVAL 1 HOUR < o.ts THEN o.ts ELSE r.w END, CASE WHEN r.w + INTERVAL 1 HOUR < o.ts THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT event_id, user_id, w AS window_start, n AS count_in_window, n <= 2 AS allowed FROM r""")
def rate_limited_events(spark, sf):
    return V.rate_limited(table(spark, sf, "events"), "user_id", "ts", "event_id", 2, 3600)


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id % 50 AS provider, ts, event_id % 7 = 0 AS out, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, provider, ts, k, false AS resting, CASE WHEN out THEN ts + INTERVAL 20 HOUR END AS until FROM o WHERE k = 1
UNION ALL SELECT o.event_id, o.provider, o.ts, o.k, coalesce(o.ts < r.until, false), CASE WHEN o.ts < r.until THEN r.until WHEN o.out THEN o.ts + INTERVAL 20 HOUR END FROM r JOIN o ON o.provider = r.provider AND o.k = r.k + 1)
SELECT event_id, provider, resting, until FROM r""")
def resting_providers(spark, sf):
    """All events as attempts at fifty providers, whose quota every seventh finds exhausted."""
    attempts = table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("provider"), "ts", (F.col("event_id") % 7 == 0).alias("exhausted"))
    return V.cooled_down(attempts, "provider", "ts", "event_id", "exhausted", 20 * 60)


@query("SELECT event_id, CASE WHEN user_id % 4 > 0 THEN user_id::VARCHAR END AS user_id FROM events")
def fk_nulling(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return R.keep_known(events, "user_id", events.filter("user_id % 4 > 0"), "user_id").withColumn("user_id", F.col("user_id").cast("string"))


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE user_id % 4 = 0)")
def cascade_delete(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return R.cascade(events, "user_id", events.filter("user_id % 4 = 0"), "user_id")


@query("SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN user_id::VARCHAR END AS user_id FROM events")
def set_null_delete(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    return R.set_null(events, "user_id", events.filter("user_id % 4 = 0"), "user_id").withColumn("user_id", F.col("user_id").cast("string"))


COURTS = "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '' ELSE n_name END AS court FROM customer JOIN nation ON c_nationkey = n_nationkey"


def courts(spark, sf) -> DataFrame:
    k = F.col("c_custkey") % 9
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_custkey", F.when(k == 0, None).when(k == 1, "").otherwise(F.col("n_name")).alias("court"))


@query(f"SELECT * FROM ({COURTS}) WHERE court IS NULL OR court = '' OR court IN (SELECT min(n_name) FROM nation GROUP BY n_regionkey)")
def null_preserving_filter(spark, sf):
    own = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("n")).collect()  # a row for each region: an allow-list
    return R.null_preserving(courts(spark, sf), "court", [r["n"] for r in own])


@query("SELECT r_name, n_name FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE k <= 2")
def core_courts(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = both.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))  # fixed dimension of 25 rows
    return lists.select("r_name", F.explode(F.slice("x", 1, 2)).alias("c")).select("r_name", "c.n_name")


@query("SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, name LIMIT 8")
def top8_nations(spark, sf):
    counts = A.counted(table(spark, sf, "customer"), "c_nationkey")
    named = counts.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "n")
    return A.top_groups(named, "name", 8)


@query("SELECT o_orderkey, o_orderdate, concat_ws(' · ', nullif(o_orderstatus, 'O'), o_orderpriority) AS label FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8")
def latest_8_orders(spark, sf):
    last = table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(8)
    return last.select("o_orderkey", "o_orderdate", S.joined(" · ", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority")).alias("label"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id = 7")
def conjunctive_equality(spark, sf):
    return table(spark, sf, "events").filter((F.col("event_type") == "click") & (F.col("user_id") == 7)).select("event_id", "user_id")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, substr('{"event_type":"' || event_type || '","props":' || to_json(props) || '}', 1, 24) AS metadata FROM events""")
def json_props_extract(spark, sf):
    from ..sources.ingest import serialised

    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), serialised(F.struct("event_type", "props"), 24).alias("metadata"))


@query("""SELECT event_id, list_filter([CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'action' END, CASE WHEN k > 80 THEN 'k' END, CASE WHEN value < 0 THEN 'value' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def validated_events(spark, sf):
    from ..sources.ingest import Rule, checked

    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("action"), F.from_json("props", "k long")["k"].alias("k"), "value")
    return checked(rows, [Rule("action", True, ("click", "view", "purchase")), Rule("k", True, high=80), Rule("value", low=0)]).select("event_id", "reasons")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'error') GROUP BY 1")
def server_only_excluded(spark, sf):
    return A.counted(table(spark, sf, "events").filter(~F.col("event_type").isin("purchase", "error")), "event_type")


AGENTS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Mozilla/5.0 GoogleBot' WHEN 3 THEN 'curl/8' ELSE 'Mozilla/5.0 ' || url END AS agent, url FROM pages"


@query(f"SELECT page_id, agent FROM ({AGENTS}) WHERE NOT (agent IS NULL OR agent = '' OR regexp_matches(agent, '(?i)bot|crawl|spider|slurp|facebookexternalhit|preview|lighthouse|headless|curl|wget'))")
def bots_excluded(spark, sf):
    k = F.col("page_id") % 5
    agent = F.when(k == 0, None).when(k == 1, "").when(k == 2, "Mozilla/5.0 GoogleBot").when(k == 3, "curl/8").otherwise(F.concat(F.lit("Mozilla/5.0 "), F.col("url")))
    return table(spark, sf, "pages").select("page_id", agent.alias("agent")).filter(~S.is_bot(F.col("agent")))


@query("SELECT page_id, regexp_matches(lower(substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, CASE WHEN page_id % 3 = 0 THEN 11 ELSE 12 END)), '^[0-9a-f-]{36}$') AS valid FROM pages")
def browser_ids(spark, sf):
    h = F.md5("url")
    last = F.when(F.col("page_id") % 3 == 0, F.substring(h, 21, 11)).otherwise(F.substring(h, 21, 12))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), last)
    return table(spark, sf, "pages").select("page_id", S.is_browser_id(made).alias("valid"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/' ELSE substr(url, 1, 20) END AS path FROM pages")
def default_and_cap(spark, sf):
    path = F.when(F.col("page_id") % 4 > 0, F.col("url"))
    return table(spark, sf, "pages").select("page_id", S.cap(F.coalesce(path, F.lit("/")), 20).alias("path"))


@query("SELECT page_id, CASE WHEN page_id BETWEEN 1 AND 20 AND page_id % 6 > 0 THEN CAST(page_id AS INT) ELSE -1 END AS page FROM pages")
def page_number_check(spark, sf):
    said = F.when(F.col("page_id") % 6 == 0, "x").otherwise(F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", F.coalesce(S.valid_page(said), F.lit(-1)).alias("page"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)password|encrypt') THEN 'password_protected' WHEN regexp_matches(text, '(?i)invalid|corrupt|not a') THEN 'invalid_file' WHEN regexp_matches(text, '(?i)memory|too large|size') THEN 'too_large'
WHEN regexp_matches(text, '(?i)network|fetch|timeout') THEN 'network' ELSE 'engine_error' END AS code FROM conversations""")
def error_codes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.first_rule(F.col("text"), S.ERROR_CODES, "engine_error").alias("code"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'local' WHEN page_id % 3 = 1 THEN '10.0.0.' || page_id ELSE '192.168.0.1' END AS address FROM pages")
def client_addresses(spark, sf):
    k = F.col("page_id") % 3
    forwarded = F.when(k == 1, F.concat(F.lit(" 10.0.0."), F.col("page_id").cast("string"), F.lit(" , 8.8.8.8"))).when(k == 2, " ,1.1.1.1")
    return table(spark, sf, "pages").select("page_id", S.client_address(forwarded, F.when(k == 2, "192.168.0.1")).alias("address"))


@query("SELECT c_custkey * 2 AS c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 2 FROM customer)")
def append_new_ids(spark, sf):
    seen = table(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name")
    return R.append_new(seen, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), "c_custkey")


@query("SELECT page_id, 'https://site.example' || CASE WHEN page_id = 0 THEN '' WHEN page_id % 2 = 0 THEN '/opinion/' || page_id || '/' ELSE '/p/' || page_id END AS link, '?q=' || replace(replace(url, ':', '%3A'), '/', '%2F') AS q FROM pages WHERE NOT regexp_matches(url, '[^a-zA-Z0-9:/._-]') UNION ALL SELECT page_id, 'https://site.example' || CASE WHEN page_id = 0 THEN '' WHEN page_id % 2 = 0 THEN '/opinion/' || page_id || '/' ELSE '/p/' || page_id END, NULL FROM pages WHERE regexp_matches(url, '[^a-zA-Z0-9:/._-]')")
def display_links(spark, sf):
    path = F.when(F.col("page_id") % 2 > 0, F.concat(F.lit("/p/"), F.col("page_id").cast("string")))
    q = F.when(~F.col("url").rlike("[^a-zA-Z0-9:/._-]"), F.concat(F.lit("?q="), S.percent_encoded(F.col("url"))))
    return table(spark, sf, "pages").select("page_id", S.display_url(path, F.col("page_id"), "https://site.example").alias("link"), q.alias("q"))
