"""Queries of text and search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import scalars as S
from ..operators import index as I
from ..operators import records as R
from ..operators import search as X
from ..operators.scratch import scratch
from .registry import query, table

DECODED = "t"
for _entity, _sign in S.ENTITIES + [("&amp;", "&")]:
    _entity, _sign = _entity.replace("'", "''"), _sign.replace("'", "''")
    DECODED = f"replace({DECODED}, '{_entity}', '{_sign}')"


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?i)</(p|div|h[0-9]|li|blockquote|br)>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, {DECODED} AS t FROM a)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM b""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.html_to_text(F.col("html")).alias("text"))


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace({DECODED}, '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM a)
SELECT page_id, CASE WHEN length(t) > 200 THEN regexp_replace(substr(t, 1, 200), '\s+\S*$', '') || '…' ELSE t END AS snippet FROM b""")
def snippet(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.snippet(F.col("html"), 200).alias("snippet"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) AS words FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.word_count(F.col("text")).cast("long").alias("words"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 1900 THEN regexp_replace(substr(text, 1, 900), '\s+\S*$', '') || ' [...] ' || regexp_replace(right(text, 500), '^\S*\s+', '') ELSE text END AS excerpt FROM documents""")
def condense(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.condense(F.col("text"), 900, 500, 500, " [...] ").alias("excerpt"))


@query("""WITH k AS (SELECT conv_id, list_slice(list(CASE WHEN turn % 2 = 0 THEN role || ' ' || turn ELSE role END ORDER BY turn), 1, 1 + conv_id % 4) AS ws FROM conversations GROUP BY 1),
q AS (SELECT conv_id, list_transform(ws, lambda w: CASE WHEN contains(w, ' ') THEN '"' || w || '"' ELSE w END) AS q FROM k)
SELECT conv_id, CASE WHEN len(q) < 3 THEN array_to_string(q, ' OR ') ELSE '(' || q[1] || ' OR ' || q[2] || ') AND (' || array_to_string(q[3:], ' OR ') || ')' END AS boolean_query FROM q""")
def query_from_keywords(spark, sf):
    word = F.when(F.col("turn") % 2 == 0, F.concat_ws(" ", "role", F.col("turn").cast("string"))).otherwise(F.col("role"))
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", word.alias("w")))), lambda x: x["w"]).alias("ws"))
    return own.select("conv_id", S.query_from_keywords(F.slice("ws", F.lit(1), (1 + F.col("conv_id") % 4).cast("int"))).alias("boolean_query"))


HIT = "(regexp_matches(lower(text), '(^|[^a-z0-9])license([^a-z0-9]|$)') OR regexp_matches(lower(text), '(^|[^a-z0-9])licensed\\s+under([^a-z0-9]|$)')) AND NOT regexp_matches(lower(text), '(^|[^a-z0-9])mit([^a-z0-9]|$)')"


@query(f"SELECT doc_id FROM documents WHERE {HIT}")
def boolean_retrieval(spark, sf):
    return X.retrieve(table(spark, sf, "documents"), "text", '(license OR "licensed under") AND NOT mit').select("doc_id")


@query(f"""WITH h AS (SELECT doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z0-9])license([^a-z0-9]|$)')) + len(regexp_extract_all(lower(text), '(^|[^a-z0-9])licensed\\s+under([^a-z0-9]|$)')) AS score FROM documents WHERE {HIT}),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h) SELECT doc_id, rank, (SELECT count(*) FROM r) > 10 AS has_more FROM r WHERE rank BETWEEN 6 AND 10""")
def boolean_retrieval_page(spark, sf):
    hits = X.retrieve(table(spark, sf, "documents"), "text", '(license OR "licensed under") AND NOT mit').select("doc_id", "score")
    return R.page_window(hits, [F.desc("score"), F.asc("doc_id")], 2).select("doc_id", F.col("rank").cast("long").alias("rank"), "has_more")


@query(f"""SELECT doc_id, (len(regexp_extract_all(lower(text), '(^|[^a-z0-9])license([^a-z0-9]|$)')) + len(regexp_extract_all(lower(text), '(^|[^a-z0-9])licensed\\s+under([^a-z0-9]|$)')))::INT AS score FROM documents WHERE {HIT}""")
def indexed_retrieval(spark, sf):
    """The index of all documents, built and asked."""
    index = I.build_index(table(spark, sf, "documents"), "doc_id", "text", scratch(spark, "index"))
    return I.lookup(index, '(license OR "licensed under") AND NOT mit').select(F.col("doc").alias("doc_id"), "score")


@query("SELECT doc_id, 1 AS attempt FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])licen')")
def fallback_cascade(spark, sf):
    """The first query finds nothing, so the second one's hits count."""
    return X.first_answer(table(spark, sf, "documents"), "text", ["license AND zzyzx", "licen*", "the"]).select("doc_id", "attempt")


@query("""SELECT doc_id, regexp_matches(text, '(?i)seiz') AND regexp_matches(text, '(?i)epilep|medical|hospital') AND NOT regexp_matches(text, '(?i)police|officer') AS medical, list_filter([CASE WHEN regexp_matches(text, '(?i)licen') AND NOT regexp_matches(text, '(?i)apache|mit') THEN 'license' END,
CASE WHEN regexp_matches(text, '(?i)version') AND NOT regexp_matches(text, '(?i)gnu') THEN 'version' END], lambda x: x IS NOT NULL) AS reasons FROM documents""")
def guarded_terms(spark, sf):
    t = F.col("text")
    medical = t.rlike("(?i)seiz") & t.rlike("(?i)epilep|medical|hospital") & ~t.rlike("(?i)police|officer")
    return table(spark, sf, "documents").select("doc_id", medical.alias("medical"), X.unjustified(t, t, [("licen", "apache|mit", "license"), ("version", "gnu", "version")]).alias("reasons"))


VOCABULARY = [X.Term("license", "licen", ("license", "licensed under")), X.Term("copyleft", "gnu", ("gnu", "copyleft")), X.Term("apache", "apache", ("apache",), needs="version"), X.Term("permissive", "(?<![A-Za-z0-9_])mit(?![A-Za-z0-9_])", ("mit", "license"))]


#: DuckDB: which terms of VOCABULARY suit a document, and their keywords.
_FOUND = r"""WITH f AS (SELECT doc_id, regexp_matches(text, '(?i)licen') AS a, regexp_matches(text, '(?i)gnu') AS b, regexp_matches(text, '(?i)apache') AND regexp_matches(text, '(?i)version') AS c, regexp_matches(text, '(?i)\bmit\b') AS d FROM documents),
k AS (SELECT *, list_filter([CASE WHEN a THEN 'license' END, CASE WHEN b THEN 'copyleft' END, CASE WHEN c THEN 'apache' END, CASE WHEN d THEN 'permissive' END], lambda x: x IS NOT NULL) AS found FROM f)"""


@query(_FOUND + """ SELECT doc_id, found || list_slice(['software', 'code', 'terms'], 1, greatest(0, 3 - len(found))) AS keywords FROM k""")
def planned_keywords(spark, sf):
    return X.plan_query(table(spark, sf, "documents").select("doc_id", "text"), "text", VOCABULARY, ["software", "code", "terms"]).select("doc_id", "keywords")


@query(
    _FOUND
    + """, p AS (SELECT doc_id, found || list_slice(['software', 'code', 'terms'], 1, greatest(0, 3 - len(found))) AS w, list_slice(list_filter([CASE WHEN a THEN '(license OR "licensed under")' END, CASE WHEN b THEN '(gnu OR copyleft)' END, CASE WHEN c THEN '(apache)' END, CASE WHEN d AND NOT a THEN '(mit OR license)' END], lambda x: x IS NOT NULL), 1, 3) AS g FROM k),
q AS (SELECT doc_id, CASE WHEN len(g) >= 2 THEN array_to_string(g, ' AND ') WHEN len(g) = 1 THEN g[1] || ' AND (' || array_to_string(w[2:], ' OR ') || ')' WHEN len(w) < 3 THEN array_to_string(w, ' OR ') ELSE '(' || w[1] || ' OR ' || w[2] || ') AND (' || array_to_string(w[3:], ' OR ') || ')' END AS q,
CASE WHEN len(g) >= 3 THEN g[1] || ' AND ' || g[2] ELSE array_to_string(w, ' OR ') END AS b FROM p)
SELECT doc_id, q AS boolean_query, b AS broad_query, q AS sent FROM q"""
)
def planned_queries(spark, sf):
    return X.plan_query(table(spark, sf, "documents").select("doc_id", "text"), "text", VOCABULARY, ["software", "code", "terms"]).select("doc_id", "boolean_query", "broad_query", P.sanitized("boolean_query").alias("sent"))


#: Terms, what texts that bear them out must show, and why.
GUARDS = [("licen", "apache|mit", "license"), ("copyleft", "version", "version")]


@query(_FOUND + """ SELECT k.doc_id, list_filter(found, lambda x: NOT (x = 'license' AND NOT regexp_matches(text, '(?i)apache|mit')) AND NOT (x = 'copyleft' AND NOT regexp_matches(text, '(?i)version'))) AS keywords FROM k JOIN documents USING (doc_id)""")
def supported_keywords(spark, sf):
    planned = X.plan_query(table(spark, sf, "documents").select("doc_id", "text"), "text", VOCABULARY, [])
    return X.without_unsupported(planned, "keywords", [], "text", GUARDS).select("doc_id", "keywords")


@query("""SELECT doc_id, CASE WHEN lic AND ver THEN b || a WHEN lic THEN b || ' AND ' || w WHEN ver THEN a[6:] ELSE w END AS q, CASE WHEN lic AND ver THEN '  copyleft  OR licensing' WHEN lic THEN 'licensing' WHEN ver THEN 'copyleft' ELSE '' END AS r
FROM (SELECT doc_id, '(license OR "apache license")' AS b, ' AND (w' || doc_id % 7 || ' OR copyleft*) AND "open source"' AS a, '(w' || doc_id % 7 || ') AND "open source"' AS w, coalesce(regexp_matches(text, '(?i)apache|mit'), false) AS lic, coalesce(regexp_matches(text, '(?i)version'), false) AS ver FROM documents)""")
def supported_queries(spark, sf):
    """Two queries of each document without the terms that its text doesn't bear out."""
    q = F.concat(F.lit('(license OR "apache license") AND (w'), F.col("doc_id") % 7, F.lit(' OR copyleft*) AND "open source"'))
    own = table(spark, sf, "documents").select("doc_id", "text", q.alias("q"), F.lit("  copyleft  OR licensing").alias("r"), F.array(F.lit("x")).alias("k"))
    return X.without_unsupported(own, "k", ["q", "r"], "text", GUARDS).select("doc_id", "q", "r")


@query("SELECT conv_id, coalesce(min(turn) FILTER (role = 'assistant' AND turn > 0), min(turn) FILTER (turn > 0), -1) AS opinion FROM conversations GROUP BY 1")
def opinion_pick(spark, sf):
    opinion = F.struct(F.col("turn").alias("id"), F.when(F.col("role") == "assistant", "lead-opinion").otherwise("dissent").alias("type"))
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(opinion)).alias("o"))
    return own.select("conv_id", F.coalesce(X.pick_opinion(F.col("o")), F.lit(-1)).alias("opinion"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(trim(text)) > 2000 THEN 'plain' WHEN length(trim(text)) > 200 THEN 'html' ELSE '' END AS field FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents)""")
def field_priority(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    picked = docs.select("doc_id", "text", F.when((F.col("doc_id") % 2 == 0) & (F.length("text") > 2000), F.col("text")).alias("plain"), F.concat(F.lit("<b>html</b>"), F.col("text")).alias("html"), F.length("text").alias("n"))
    body = S.first_long([("plain", True), ("html", False)], 200)
    return picked.select("doc_id", F.when(F.col("plain").isNotNull() & (F.length(body) > 0), "plain").when(F.col("n") > 200, F.when(body.startswith("html"), "html")).otherwise("").alias("field"))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE text <> '') WHERE k <= 5")
def first_five_named(spark, sf):
    return table(spark, sf, "documents").filter("text <> ''").orderBy("doc_id").limit(5).select("doc_id", "text")


#: DuckDB: the sentences of {text} on one line. Ends are marked by chr(1), then unmarked after abbreviations, which may follow each other.
_MARKED = r"""regexp_replace(trim(regexp_replace({text}, '\s+', ' ', 'g')), '([.!?]["'')\]”]?) (["''(“]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g')"""
_SHORTENED = r"""'((?:^|[\s(\x01])(?:v|vs|Inc|Co|Corp|Ltd|LLC|No|Nos|St|Mr|Mrs|Ms|Dr|Jr|Sr|Cal|App|Cir|Ct|Supp|Dist|Div|Dept|Ass''n|Bros|Gen|Stat|Ann|Rev|Sec|Art|al|e\.g|i\.e|U\.S|N\.Y|[A-Z])\.)\x01', '\1 ', 'g'"""
_SENTENCES = "list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(" + _MARKED + f", {_SHORTENED}), {_SHORTENED}), {_SHORTENED}), chr(1)), lambda s: s <> '')"
_COUNT = r"len(list_filter(string_split({text}, ' '), lambda w: regexp_matches(w, '[A-Za-z0-9]')))"
_HAY = r"""' ' || trim(regexp_replace(regexp_replace(replace(lower(text), '’', chr(39)), '[^a-z0-9§''\s-]', ' ', 'g'), '\s+', ' ', 'g')) || ' '"""


@query(f"SELECT doc_id, {_SENTENCES.format(text='text')} AS sentences FROM documents")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.sentences(F.col("text")).alias("sentences"))


@query(
    rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    s AS (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT doc_id, {_SENTENCES.format(text='t')} AS l FROM t)),
    c AS (SELECT doc_id, x[1] AS s, x[2] AS i, sum({_COUNT.format(text='x[1]')}) OVER (PARTITION BY doc_id ORDER BY x[2]) AS n FROM s),
    k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) FILTER (n <= 150) AS whole, max(n) FILTER (n <= 150) AS n FROM c GROUP BY 1),
    w AS (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT doc_id, string_split(t, ' ') AS l FROM t)),
    d AS (SELECT doc_id, x[1] AS w, x[2] AS i, sum(regexp_matches(x[1], '[A-Za-z0-9]')::INT) OVER (PARTITION BY doc_id ORDER BY x[2]) AS n FROM w),
    cut AS (SELECT doc_id, regexp_replace(string_agg(w, ' ' ORDER BY i) FILTER (n <= 150), '[,;:–—-]+$', '') || '…' AS cut FROM d GROUP BY 1)
    SELECT t.doc_id, CASE WHEN {_COUNT.format(text='t')} <= 150 THEN t WHEN k.n >= 100 THEN whole ELSE cut END AS summary
    FROM t LEFT JOIN k USING (doc_id) LEFT JOIN cut USING (doc_id)"""
)
def clamped_summaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.clamped(F.col("text")).alias("summary"))


@query(f"SELECT doc_id, regexp_matches({_HAY}, ' licensed under license| licen.{{0,72}} under| under.{{0,78}} licen') AS present FROM documents")
def keyword_presence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.appears(P.haystack(F.col("text")), F.lit("licensed under license")).alias("present"))


@query()
def extractive_summary(spark, sf):
    pool = ["apache", "gnu", "license", "version"]
    own = table(spark, sf, "documents").select("doc_id", "text")
    return P.summarised(own, "text", F.array(F.lit("license"), F.lit("software")), pool, F.lit("Licence"), F.lit("all states")).drop("text")


@query()
def polished_bullets(spark, sf):
    from ..functions.rewriting import generic, polished

    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", "pos", polished(F.col("line")).alias("bullet"), generic(F.col("line")).alias("generic"))


@query(r"""SELECT doc_id, 'Jane Doe' AS name, 'Engineer' AS title, 'Dev' AS role, source AS company, '2019' AS began, '2021' AS ended,
    trim(regexp_replace('- ' || replace(text, chr(10), ' '), '^[\s•\-–—*·▪◦►]+', '')) AS bullet, 'University of ' || lang AS school, 'B.S.' AS degree, 'Physics' AS field FROM documents""")
def parsed_resumes(spark, sf):
    from ..functions.rewriting import parsed_resumes as parsed

    sections = F.concat(F.lit("Jane Doe\nEngineer\nExperience\nDev at "), F.col("source"), F.lit(" 2019 - 2021\n- "), F.translate("text", "\n", " "), F.lit("\nEducation\nUniversity of "), F.col("lang"), F.lit("\nB.S. in Physics 2014 - 2018"))
    rows = parsed(table(spark, sf, "documents").select("doc_id", sections.alias("t")), "t", "doc_id", "r")
    job, school = F.get("r.experience", F.lit(0)), F.get("r.education", F.lit(0))
    return rows.select("doc_id", "r.name", "r.title", job["role"].alias("role"), job["company"].alias("company"), job["start"].alias("began"), job["end"].alias("ended"), F.array_join(job["bullets"], " ").alias("bullet"), school["school"].alias("school"), school["degree"].alias("degree"), school["field"].alias("field"))


@query("SELECT doc_id, sha256(text) AS digest, base64(encode(lang)) AS lang64, hex(encode(source)) AS source_hex FROM documents")
def digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.base64(F.encode("lang", "UTF-8")).alias("lang64"), F.hex(F.encode("source", "UTF-8")).alias("source_hex"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / 7 * 10 + 0.5) / 10 AS rounded FROM lineitem")
def half_up_rounding(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.half_up(F.col("l_extendedprice") / 7, 1).alias("rounded"))
