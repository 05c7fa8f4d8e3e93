"""Queries of ordered and statistical operators: medians, clusters, coverage, dedup, fills, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import records as R
from ..operators import stats as O
from .registry import query, table

NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query("SELECT l_returnflag, l_linestatus, v[len(v) // 2 + 1] AS median FROM (SELECT l_returnflag, l_linestatus, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY ALL)")
def upper_median(spark, sf):
    return O.upper_median(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("SELECT l_suppkey, v[floor(0.97 * (len(v) - 1))::INT + 1] AS p97 FROM (SELECT l_suppkey, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY ALL)")
def floor_percentile(spark, sf):
    return O.floor_percentile(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.97, "p97")


@query("""WITH w AS (SELECT l_suppkey, l_quantity, sum(l_linenumber) AS w, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_quantity AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, f, l_quantity DESC) AS k FROM w) WHERE k = 1""")
def weighted_mode(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return O.weighted_mode(rows, ["l_suppkey"], "l_quantity", "l_linenumber", "seq")


@query("""WITH v AS (SELECT p_brand, p_retailprice, count(*) AS c FROM part GROUP BY ALL), g AS (SELECT *, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) <= 2 THEN 0 ELSE 1 END AS fresh FROM v),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT p_brand, min(p_retailprice) AS "first", round(sum(p_retailprice * c) / sum(c), 4) AS mean, sum(c)::BIGINT AS "size" FROM k GROUP BY p_brand, k HAVING sum(c) >= 2""")
def gap_clusters(spark, sf):
    out = O.cluster_values(table(spark, sf, "part"), ["p_brand"], "p_retailprice", 2.0, 2)
    return out.select("p_brand", "first", F.round("mean", 4).alias("mean"), "size")


@query("""WITH c AS (SELECT l_suppkey, greatest(l_quantity * 20, 100.0) AS b, max(least(l_quantity * 20 + l_discount * 100, 900.0)) AS e FROM lineitem WHERE least(l_quantity * 20 + l_discount * 100, 900.0) > greatest(l_quantity * 20, 100.0) GROUP BY ALL),
f AS (SELECT l_suppkey, greatest(0.0, e - greatest(b, coalesce(max(e) OVER (PARTITION BY l_suppkey ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b))) AS x FROM c)
SELECT l_suppkey, round(sum(x) / 800, 6) AS covered FROM f GROUP BY 1""")
def interval_coverage(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") * 20).alias("b"), (F.col("l_quantity") * 20 + F.col("l_discount") * 100).alias("e"))
    return O.coverage(rows, ["l_suppkey"], "b", "e", 100.0, 900.0).select("l_suppkey", F.round("covered", 6).alias("covered"))


@query("SELECT l_suppkey, min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_extendedprice) AS min_y, max(l_extendedprice) AS max_y FROM lineitem GROUP BY 1")
def bounding_boxes(spark, sf):
    return O.bounds(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")


@query("""WITH m AS (SELECT source, doc_id, regexp_replace(trim(split_part(text, chr(10), 1)), '[0-9]+', '#', 'g') AS masked FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''), p AS (SELECT source, count(DISTINCT doc_id) AS p FROM documents GROUP BY 1)
SELECT source, masked, count(DISTINCT doc_id) AS n FROM m JOIN p USING (source) GROUP BY source, masked, p HAVING n >= greatest(2, ceil(p * 0.04))""")
def repeated_first_lines(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.element_at(F.split("text", "\n"), 1).alias("line"))
    return O.running_lines(docs, "source", "doc_id", "line", 0.04)


@query("""SELECT 'de' AS term, sum(len(string_split(lower(text), 'de')) - 1)::BIGINT AS n FROM documents UNION ALL SELECT 'the', sum(len(string_split(lower(text), 'the')) - 1)::BIGINT FROM documents UNION ALL SELECT 'license', sum(len(string_split(lower(text), 'license')) - 1)::BIGINT FROM documents""")
def term_frequencies(spark, sf):
    return A.term_frequency(table(spark, sf, "documents"), "text", ["the", "de", "license"])


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS types FROM events GROUP BY 1")
def joined_types(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("types"))


@query(f"SELECT count(*) AS n, count(*) FILTER ({NORM} IS DISTINCT FROM trim(regexp_replace(lower(text || CASE WHEN doc_id % 3 = 0 THEN ' x' ELSE '!' END), '[^a-z0-9]+', ' ', 'g'))) AS changed FROM documents")
def change_counters(spark, sf):
    docs = table(spark, sf, "documents").withColumn("after", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " x").otherwise("!")))
    return A.change_counts(docs, "text", "after", S.norm_key)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, {NORM} ORDER BY doc_id) AS k FROM documents WHERE {NORM} <> '') WHERE k = 1")
def first_occurrence_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", S.norm_key(F.col("text")).alias("k"))
    return R.first_occurrences(docs.select("doc_id", "lang", "k"), ["lang"], F.col("k"), ["doc_id"]).select("doc_id")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def forward_fill(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("asked"))
    return R.forward_fill(rows, ["conv_id"], "turn", "asked")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_turn_wins(spark, sf):
    return R.last_wins(table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "text")


@query("""WITH f AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id ORDER BY toxic DESC) AS k FROM labels)
SELECT d.doc_id, coalesce(f.quality, 9) AS quality FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id AND k = 1""")
def model_output_overlay(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", F.lit(9).alias("quality"))
    return R.overlaid(base, table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "toxic", ["quality"])


@query("SELECT o_orderkey, o_custkey, round(least(72.0, greatest(0.0, coalesce(o_totalprice / 1000 - lag(o_totalprice / 1000 - 5) OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 1000), 0.0))), 5) AS space_before FROM orders")
def block_spacing(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("top"), (F.col("o_totalprice") / 1000 - 5).alias("bottom"))
    return O.spacing(rows, ["o_custkey"], "top", "bottom").select("o_orderkey", "o_custkey", F.round("space_before", 5).alias("space_before"))


@query("SELECT conv_id, turn, coalesce(role <> lag(role) OVER w, true) AS opens, coalesce(role <> lead(role) OVER w, true) AS closes FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_roles(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).alias("opens"), F.coalesce(F.col("role") != F.lead("role").over(w), F.lit(True)).alias("closes"))


@query("""WITH g AS (SELECT *, CASE WHEN o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) <= greatest(2.2 * 9000, 18) THEN 0 ELSE 1 END AS fresh FROM orders)
SELECT o_orderkey, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_totalprice ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g""")
def segment_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return O.sessions_by_gap(rows, ["o_custkey"], "o_totalprice", lambda w: F.col("o_totalprice") - F.lag("o_totalprice").over(w) <= max(2.2 * 9000, 18)).select("o_orderkey", "segment")


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS position FROM nation")
def ordinals(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).cast("long").alias("position"))


@query("SELECT p_brand, p_size, tier FROM (SELECT DISTINCT p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS tier FROM part) WHERE tier <= 3")
def heading_tiers(spark, sf):
    return O.distinct_top(table(spark, sf, "part"), ["p_brand"], "p_size", 3).withColumn("tier", F.col("tier").cast("long"))


@query("SELECT o_orderkey, rank, true AS has_more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank BETWEEN 11 AND 15")
def page_window(spark, sf):
    out = R.page_window(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return out.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "has_more")


@query("SELECT n_name AS name, 0 AS source FROM nation UNION ALL SELECT r_name, 1 FROM region")
def ordered_union(spark, sf):
    return R.ordered_union(table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("SELECT k, coalesce(c_name, s_name) AS name FROM (SELECT c_custkey * 3 AS k, c_name FROM customer) FULL JOIN (SELECT s_suppkey AS k, s_name FROM supplier) USING (k)")
def union_distinct(spark, sf):
    first = table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("k"), F.col("c_name").alias("name"))
    return R.union_distinct(first, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k")


LINES = f"SELECT DISTINCT doc_id, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def line_keys(spark, sf, where: str):
    docs = table(spark, sf, "documents").filter(where).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return docs.select("doc_id", S.norm_key(F.col("line")).alias("k")).distinct()


@query(f"WITH l AS ({LINES}), s AS (SELECT DISTINCT k FROM l WHERE doc_id % 2 = 0 AND len(string_split(k, ' ')) >= 4) SELECT doc_id, k FROM l WHERE doc_id % 2 = 1 AND (k IN (SELECT k FROM s) OR regexp_replace(k, '^[^ ]+ ', '') IN (SELECT k FROM s))")
def semi_unchanged(spark, sf):
    return R.unchanged(line_keys(spark, sf, "doc_id % 2 = 1"), line_keys(spark, sf, "doc_id % 2 = 0"), "k")


@query(f"WITH l AS ({LINES}) SELECT doc_id, k FROM l WHERE doc_id % 2 = 1 AND k NOT IN (SELECT k FROM l WHERE doc_id % 2 = 0)")
def except_unchanged(spark, sf):
    return line_keys(spark, sf, "doc_id % 2 = 1").join(line_keys(spark, sf, "doc_id % 2 = 0").select("k").distinct(), "k", "left_anti").select("doc_id", "k")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND len(list_intersect(string_split(a.n_name, ''), string_split(b.n_name, ''))) > 0")
def overlapping_names(spark, sf):
    n = table(spark, sf, "nation").withColumn("s", F.split("n_name", ""))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & F.arrays_overlap("a.s", "b.s")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT conv_id, list_slice(list(role ORDER BY turn), 1, 3) AS kept, count(*) <= 3 AS accepted FROM conversations GROUP BY 1")
def bounded_lists(spark, sf):
    """slice cuts a long list, a limit on the field refuses it; both are kept apart."""
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return own.select("conv_id", F.slice("roles", 1, 3).alias("kept"), (F.size("roles") <= 3).alias("accepted"))


@query("SELECT user_id, list(event_type ORDER BY ts, event_type, value)[1] AS a, list(value ORDER BY ts, event_type, value)[1] AS b FROM events GROUP BY 1")
def positional_zip(spark, sf):
    first = F.min(F.struct("ts", "event_type", "value")).alias("x")
    return table(spark, sf, "events").groupBy("user_id").agg(first).select("user_id", F.col("x.event_type").alias("a"), F.col("x.value").alias("b"))


@query("""WITH RECURSIVE up AS (SELECT n_nationkey AS id, n_nationkey AS here, CASE WHEN n_nationkey % 4 = 0 THEN n_name END AS v, 0 AS d FROM nation
UNION ALL SELECT id, here - 1, CASE WHEN (here - 1) % 4 = 0 THEN n_name END, d + 1 FROM up JOIN nation ON n_nationkey = here - 1 WHERE v IS NULL)
SELECT id, max(v) AS v FROM up GROUP BY 1""")
def style_inheritance(spark, sf):
    k = F.col("n_nationkey")
    styles = table(spark, sf, "nation").select(k.alias("id"), F.when(k > 0, k - 1).alias("parent"), F.when(k % 4 == 0, F.col("n_name")).alias("v"))
    return R.inherited(styles, "id", "parent", ["v"]).select("id", "v")
