"""Queries of nested records and their layout, and of loads, over records made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.rewriting import RESUME
from ..operators import records as R
from ..operators import resume as Z
from ..operators.scratch import scratch
from ..sources import ingest as I
from .registry import query, table


def made_records(spark, sf) -> DataFrame:
    """(conv_id, record): all conversations as résumé records; assistant turns are jobs, system turns schools, user turns the rest."""
    n, t = F.length("text"), F.col("turn")
    text = lambda k, *v: F.concat(F.lit(k), *[x.cast("string") for x in v])
    unless = lambda c, v: F.when(c, "").otherwise(v)
    bullets = F.when(n % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring("text", 1, 20), F.substring("text", 21, 15)))
    job = F.struct(unless(n % 4 == 0, F.substring("text", 1, 10)).alias("role"), unless(n % 3 == 0, text("C", n % 7)).alias("company"), F.lit("").alias("location"), text("20", t + 10).alias("start"), unless(n % 2 == 0, F.lit("now")).alias("end"), unless(n % 5 > 0, text("K", t)).alias("client"), bullets.alias("bullets"))
    school = F.struct(unless(n % 2 > 0, text("S", n)).alias("school"), unless(n % 3 > 0, F.lit("B.S.")).alias("degree"), text("F", n).alias("field"), F.lit("").alias("start"), F.lit("").alias("end"), F.lit("").alias("details"))
    items = F.when(n % 4 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(" a "), F.lit(""), text("x", n)))
    skill = F.struct(text(" Cat", t).alias("category"), items.alias("items"))
    project = F.struct(unless(n % 2 > 0, text("P", n)).alias("name"), F.array().cast("array<string>").alias("bullets"))
    listed = lambda on, v: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct(t.alias("t"), v.alias("v"))))), lambda x: x["v"])
    user = F.col("role") == "user"
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(
        listed(F.col("role") == "assistant", job).alias("experience"),
        listed(F.col("role") == "system", school).alias("education"),
        listed(user, skill).alias("skills"),
        listed(user & (n % 5 == 0), project).alias("projects"),
        listed(user, F.when(n % 3 == 0, " ").otherwise(text("Cert ", n))).alias("certifications"),
    )
    k, blank = F.col("conv_id"), F.lit("")
    record = F.struct(unless(k % 5 == 0, text("N", k)).alias("name"), blank.alias("title"), blank.alias("email"), blank.alias("phone"), blank.alias("linkedin"), F.when(k % 4 == 0, " ").otherwise(text("Sum ", k)).alias("summary"), "experience", "education", "skills", "projects", "certifications")
    return own.select("conv_id", record.cast(RESUME).alias("record"))


MADE = """t AS (SELECT conv_id AS k, turn AS t, role, text, len(text) AS n FROM conversations),
j AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, CASE WHEN n % 4 = 0 THEN '' ELSE substring(text, 1, 10) END AS role, CASE WHEN n % 3 = 0 THEN '' ELSE 'C' || n % 7 END AS company, '20' || t + 10 AS s, CASE WHEN n % 2 = 0 THEN '' ELSE 'now' END AS e, CASE WHEN n % 5 > 0 THEN '' ELSE 'K' || t END AS client, CASE WHEN n % 6 = 0 THEN [] ELSE [substring(text, 1, 20), substring(text, 21, 15)] END AS bullets FROM t WHERE role = 'assistant'),
c AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, CASE WHEN n % 2 > 0 THEN '' ELSE 'S' || n END AS school, CASE WHEN n % 3 > 0 THEN '' ELSE 'B.S.' END AS degree, 'F' || n AS field FROM t WHERE role = 'system'),
s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, 'Cat' || t AS category, 'a, x' || n AS items FROM t WHERE role = 'user' AND n % 4 > 0),
p AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, CASE WHEN n % 2 > 0 THEN '' ELSE 'P' || n END AS name FROM t WHERE role = 'user' AND n % 5 = 0),
q AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, CASE WHEN n % 3 = 0 THEN ' ' ELSE 'Cert ' || n END AS cert FROM t WHERE role = 'user'),
r AS (SELECT DISTINCT k, k % 5 > 0 OR k IN (SELECT k FROM j WHERE trim(role) <> '' OR company <> '') AS enough, k % 4 > 0 AS summary, k IN (SELECT k FROM j WHERE role <> '' OR company <> '' OR len(bullets) > 0) AS experience, k IN (SELECT k FROM c WHERE school <> '' OR degree <> '') AS education,
k IN (SELECT k FROM t WHERE role = 'user') AS skills, k IN (SELECT k FROM p WHERE name <> '') AS projects, k IN (SELECT k FROM q WHERE trim(cert) <> '') AS certifications FROM t)"""


@query(f"WITH {MADE} SELECT k AS conv_id, enough, summary, experience, education, skills, projects, certifications FROM r")
def content_rules(spark, sf):
    r = F.col("record")
    return made_records(spark, sf).select("conv_id", Z.enough(r).alias("enough"), *[Z.has_content(r, s).alias(s) for s in Z.SECTIONS])


@query("""SELECT conv_id, string_agg(trim(' Cat' || turn) || ':' || 'a,x' || len(text), ';' ORDER BY turn) AS skills FROM conversations WHERE role = 'user' AND len(text) % 4 > 0 GROUP BY 1
UNION ALL SELECT conv_id, '' FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user' AND len(text) % 4 > 0) = 0""")
def cleaned_skills(spark, sf):
    groups = F.transform(Z.cleaned(F.col("record.skills")), lambda g: F.concat(g["category"], F.lit(":"), F.array_join(g["items"], ",")))
    return made_records(spark, sf).select("conv_id", F.array_join(groups, ";").alias("skills"))


@query(f"""WITH {MADE}, b AS (SELECT k, 0 AS section_ord, i AS item_ord, 0 AS sub_ord, 'para' AS kind, category || ': ' || items AS text FROM s
UNION ALL SELECT k, 1, 0, 0, 'para', 'Sum ' || k FROM r WHERE summary
UNION ALL SELECT k, 2, i, -1, 'entry', array_to_string(list_filter([role, company, CASE WHEN client <> '' THEN 'Client: ' || client ELSE '' END, s || CASE WHEN e <> '' THEN ' – ' || e ELSE '' END], lambda x: x <> ''), ' | ') FROM j
UNION ALL SELECT k, 2, i, n, 'bullet', bullets[n + 1] FROM (SELECT *, unnest(range(len(bullets))) AS n FROM j)
UNION ALL SELECT k, 3, i, -1, 'entry', name FROM p UNION ALL SELECT k, 4, i, 0, 'bullet', cert FROM q
UNION ALL SELECT k, 5, i, -1, 'entry', array_to_string(list_filter([school, degree, field], lambda x: x <> ''), ', ') FROM c
UNION ALL SELECT k, o, -1, -1, 'heading', h FROM r, (VALUES (0, 'Technical Skills Matrix'), (1, 'Consultant Profile'), (2, 'Client Engagements'), (3, 'Key Projects'), (4, 'Certifications'), (5, 'Education')) v(o, h))
SELECT k AS conv_id, section_ord, item_ord::BIGINT AS item_ord, sub_ord::BIGINT AS sub_ord, kind, text FROM b JOIN r USING (k) WHERE [skills, summary, experience, projects, certifications, education][section_ord + 1]""")
def record_blocks(spark, sf):
    out = Z.blocks(made_records(spark, sf), "record", "conv_id", "c2c")
    return out.select("conv_id", "section_ord", F.col("item_ord").cast("long").alias("item_ord"), F.col("sub_ord").cast("long").alias("sub_ord"), "kind", "text")


@query("SELECT c_custkey, 'via ' || CASE WHEN c_custkey % 3 = 0 THEN 'the federal courts' ELSE c_name END || CASE WHEN c_custkey % 4 > 0 THEN ' · ' || c_custkey ELSE '' END AS line FROM customer")
def contact_lines(spark, sf):
    k = F.col("c_custkey")
    place = S.jurisdiction_label(F.when(k % 3 == 0, "Federal").otherwise(F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", S.joined(" · ", F.concat(F.lit("via "), place), F.when(k % 4 > 0, k.cast("string")).otherwise(""), F.lit(None).cast("string")).alias("line"))


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS position, '{"@type":"ListItem","position":' || row_number() OVER (ORDER BY p_partkey) || ',"name":"' || p_name || '","url":"/p/' || p_partkey || '"}' AS json FROM part""")
def json_ld_items(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.lit("/p/"), "p_partkey").alias("url"))
    return I.json_ld(rows, "p_name", "url", "p_partkey")


@query("SELECT 'https://x.org/p/' || p_partkey AS url, CASE WHEN p_size % 3 = 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS priority FROM part")
def site_map(spark, sf):
    rows = table(spark, sf, "part").select(F.concat(F.lit("/p/"), "p_partkey").alias("path"), (F.col("p_size") % 3 == 0).alias("live"))
    return I.site_map(rows, "path", "live", "https://x.org")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, count(*) AS stamped FROM events GROUP BY 1")
def appended_events(spark, sf):
    """All events appended in two loads, each row with an id and time of its own, and counted as they lie."""
    path, events = scratch(spark, "events"), table(spark, sf, "events").select("event_id", "event_type")
    for k in range(2):
        I.append(I.stamped(events.filter(F.col("event_id") % 2 == k)), path)
    own = spark.read.parquet(path)
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.countDistinct("id").alias("stamped"))


@query("""WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, text AS question FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, text AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, place, question, answer FROM a FULL JOIN b USING (conv_id, place)""")
def zipped_turns(spark, sf):
    own = table(spark, sf, "conversations")
    asked = own.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = own.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return R.zipped(asked, told, ["conv_id"], "turn").withColumn("place", F.col("place").cast("long"))


#: Bullets as written, and as they should read; {x} is a word of its own for each document.
BULLETS = [
    ("• Worked on migrating {x} to aws and k8s.", "Migrate {x} to AWS and Kubernetes"),
    ("Helped build  various {x} apis in order to cut costs by 40 percent", "Support efforts to build multiple {x} APIs to cut costs by 40%"),
    ("Manages {x} , nodejs etc.", "Manage {x}, Node.js"),
    ("Developed {x}", "Developed {x}"),
    ("Was responsible for managing {x} to Building y", "Manage {x} to build y"),
    ("Architecting {x}, tested and deployed it that reduced y", "Architect {x}, test and deploy it that reduced y"),
    ("Assisted with testing {x} and wrote docs", "Test {x} and write docs"),
    ("Led {x} with the help of python", "Led {x} with Python"),
    ("- applies {x} on a daily basis;", "Applies {x} daily"),
    ("successfully utilized {x} and so on", "Use {x}"),
    ("Was tasked with {x} ,  and more", "Own {x}"),
    ("Builds {x}", "Build {x}"),
]


@query(f"SELECT doc_id, replace(({[said for _, said in BULLETS]})[doc_id % {len(BULLETS)} + 1], '{{x}}', 'gadget' || doc_id % 9) AS bullet FROM documents")
def polished_cases(spark, sf):
    from ..functions.rewriting import polished

    raw = F.element_at(F.array(*[F.lit(said) for said, _ in BULLETS]), (F.col("doc_id") % len(BULLETS) + 1).cast("int"))
    filled = F.replace(raw, F.lit("{x}"), F.concat(F.lit("gadget"), (F.col("doc_id") % 9).cast("string")))
    return table(spark, sf, "documents").select("doc_id", polished(filled).alias("bullet"))
