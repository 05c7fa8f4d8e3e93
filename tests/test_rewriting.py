from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import rewriting as W


def applied(spark, change, values):
    """change(column) of each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", change(F.col("v")).alias("x")).orderBy("i").collect()]


def test_verbs(spark):
    assert applied(spark, W.base_of_past, ["planned", "created", "applied", "trained", "monitored", "installed", "processed"]) == ["plan", "create", "apply", "train", "monitor", "install", "process"]
    assert applied(spark, W.base_of_gerund, ["migrating", "planning", "building"]) == ["Migrate", "Plan", "Build"]
    said = ["Architect, tested and deployed X", "Build X that reduced latency and improved uptime", "Design, built and wrote it", "x"]
    assert applied(spark, W.agreeing, said) == ["Architect, test and deploy X", said[1], "Design, build and write it", "x"]
    assert applied(spark, W.strong_lead, ["Developing X", "Manages Y", "Builds Z", "Reading W", "Classes", "Led it", ""]) == ["Build X", "Manage Y", "Build Z", "Reading W", "Classes", "Led it", ""]


def test_bullets(spark):
    told = {
        "• Worked on migrating services to aws and k8s.": "Migrate services to AWS and Kubernetes",
        "Helped build  various rest apis in order to cut costs by 40 percent": "Support efforts to build multiple REST APIs to cut costs by 40%",
        "Manages postgres , nodejs etc.": "Manage PostgreSQL, Node.js",
        "Developed a scheduler": "Developed a scheduler",
        "Was responsible for managing node.js.foo to Building x": "Manage node.js.foo to build x",
        " - ": "",
        None: "",
    }
    assert applied(spark, W.polished, list(told)) == list(told.values())
    assert applied(spark, W.polished_summary, ["I am a very keen python developer", None]) == ["Keen Python developer", ""]
    assert applied(spark, W.generic, ["Built a web app", "Cut latency by 30%", "Led the team", "Moved it to Kafka", None]) == [True, False, True, False, True]
    assert applied(spark, lambda c: W.rule_set(F.lit("D"), c), ["- a\n\n* b", None]) == ["\n".join(["D", "", W.USER_RULES, "1. a", "2. b"]), "\n".join(["D", "", W.USER_RULES, W.NO_RULES])]


def test_education(spark):
    rows = ["University of Texas at Austin    Austin, TX", "B.S. in Computer Science    2014 – 2018", "GPA 3.8 / 4.0, Magna Cum Laude", "Master of Science, Physics 2019 - 2021"]
    df = spark.createDataFrame([(rows,), ([],)], "rows array<string>")
    got, none = (r["e"] for r in df.select(W.merged_education(F.transform("rows", W.education_line)).alias("e")).collect())
    assert none == [] and [(e["school"], e["degree"], e["field"], e["start"], e["end"]) for e in got] == [("University of Texas at Austin", "B.S.", "Computer Science", "2014", "2018"), ("University of Texas at Austin", "Master of Science", "Physics", "2019", "2021")]
    assert got[0]["details"].startswith("GPA 3.8")
    assert applied(spark, W.split_degree, ["M.S. Electrical Engineering"])[0].asDict() == {"degree": "M.S.", "field": "Electrical Engineering"}
    one, two = applied(spark, W.education_line, ["B.Tech in IT from Indian Institute of Technology, graduated 2012", "MIT, B.S. in Physics"])
    assert (one["degree"], one["field"], one["end"]) == ("B.Tech", "IT", "2012") and (two["school"], two["degree"], two["field"]) == ("MIT", "B.S.", "Physics")


RESUME = "Ann Lee\nData Engineer\nann@x.org | +1 (555) 123-4567\nSummary\nKeen.\nExperience\nDev at Acme | 2019 - Present\nAustin, TX\n- Built a thing that\nruns well.\nClient: Foo · Remote\nSkills\nLanguages: Go, SQL\nProjects\nToy\n- fun\nCertifications\n• AWS"


def test_resumes(spark):
    texts = [RESUME, "", None, "A\nExperience\n- first\nBoston, MA\nRemote\nOps at X 2001 - 2002\n- a.\nb\nBoston, MA\nEducation\nMIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    r, empty, null, odd = (x["record"] for x in W.parsed_resumes(df, "t", "i").orderBy("i").collect())
    assert (r["name"], r["title"], r["email"], r["phone"], r["summary"]) == ("Ann Lee", "Data Engineer", "ann@x.org", "+1 (555) 123-4567", "Keen.")
    assert [e.asDict() for e in r["experience"]] == [{"role": "Dev", "company": "Acme", "location": "Remote", "start": "2019", "end": "Present", "client": "Foo", "bullets": ["Built a thing that runs well."]}]
    assert [x.asDict() for x in r["skills"]] == [{"category": "Languages", "items": ["Go", "SQL"]}] and [x.asDict() for x in r["projects"]] == [{"name": "Toy", "bullets": ["fun"]}] and r["certifications"] == ["AWS"]
    assert empty == null and empty["name"] == "" and empty["experience"] == [] and empty["education"] == []
    assert [(e["role"], e["company"], e["location"], e["bullets"]) for e in odd["experience"]] == [("", "", "", ["first", "Boston, MA", "Remote"]), ("Ops", "X", "", ["a.", "b", "Boston, MA"])]


def test_resumes_are_split_once_a_branch(spark):
    df = spark.createDataFrame([(0, RESUME), (1, " \t\n \ufeffAnn \n\n\u00a0a@b.c 12\u2028Education\nMIT \x0b B.S. in Art\n"), (2, "a@ LINKEDIN.com/in/Ann-L | +1 555 123 4567")], "i int, t string")
    plan = W.parsed_resumes(df, "t", "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\x1C-\x1E") == plan.count("Generate ") == 3
    _, odd, contact = (r["record"] for r in W.parsed_resumes(df, "t", "i").orderBy("i").collect())
    assert (odd["name"], odd["title"], odd["email"]) == ("Ann", "", "a@b.c") and [(e["school"], e["degree"], e["field"]) for e in odd["education"]] == [("MIT", "B.S.", "Art")]
    assert (contact["email"], contact["linkedin"], contact["phone"]) == ("", "LINKEDIN.com/in/Ann-L", "+1 555 123 4567")


def test_records(spark):
    from tallyforge.operators import resume as R

    text = "Ann Lee\nEngineer\nExperience\nDev at Acme | 2019 - 2021\n- Worked on building rest apis\n- worked on building REST APIs.\n- Led it\nSkills\nLang: Go,  \nEducation\nUniversity of X\nB.S. in Physics 2014 - 2018"
    df = R.structured(spark.createDataFrame([(1, text), (2, "")], "id int, text string"), "text", "id").cache()
    assert [r["e"] for r in df.orderBy("id").select(R.enough(F.col("record")).alias("e")).collect()] == [True, False]
    told = df.filter("id = 1").select(R.optimised(F.col("record")).alias("o")).select("o.changed", "o.record.experience", "o.record.skills").first()
    assert (told["changed"], told["experience"][0]["bullets"], told["skills"][0]["items"]) == (2, ["Build REST APIs", "Led it"], ["Go"])
    got = R.blocks(df, "record", "id").orderBy("section_ord", "item_ord", "sub_ord").collect()
    assert [r["text"] for r in got] == ["Professional Experience", "Dev | Acme | 2019 – 2021", "Worked on building rest apis", "worked on building REST APIs.", "Led it", "Technical Skills", "Lang: Go", "Education", "University of X, B.S., Physics, 2014 – 2018"]
    assert [r["text"] for r in R.blocks(df, "record", "id", "c2c").filter("kind = 'heading'").orderBy("section_ord").collect()] == ["Technical Skills Matrix", "Client Engagements", "Education"]
    facts = spark.createDataFrame([("X Corp", "Citizen", "", None)], "corpName string, workAuthorization string, availability string, relocation string")
    extras = facts.select(*[R.header_extras(t, F.struct("*")).alias(t.replace("-", "_")) for t in R.TEMPLATES]).first()
    assert (extras["full_time"], extras["w2"], extras["c2c"]) == ([], ["Work Authorization: Citizen", "Open to W2 Contract"], ["Corp-to-Corp via X Corp", "Work Authorization: Citizen"])
    assert R.break_line([3, 3, 3, 3], 1.0, 7.5) == [(0, 2, 1.5), (2, 4, 1.0)] and R.break_line([], 1, 5) == []
    lines = spark.createDataFrame([([3.0, 3.0, 3.0],)], "w array<double>").select(R.broken(1.0, 7.5)("w").alias("l")).first()["l"]
    assert [(x["first"], x["end"]) for x in lines] == [(0, 2), (2, 3)]


def test_models_are_asked_before_rules(spark):
    from tallyforge.operators import resume as R

    def down(text, problem):
        raise R.Unavailable

    def model(text, problem):
        return {} if text == "none" else {"name": text.upper()} if problem or text != "fix" else {"title": "x"}

    df = spark.createDataFrame([(1, "ann"), (2, "fix"), (3, "none"), (4, None)], "id int, t string").coalesce(1)
    got = {r["id"]: r["record"]["name"] for r in R.structured(df, "t", "id", [down, model]).collect()}
    assert got == {1: "ANN", 2: "FIX", 3: "none", 4: ""}

    def broken(text, problem):
        raise ValueError("a fault")

    with pytest.raises(Exception, match="a fault"):
        R.structured(df, "t", "id", [broken]).collect()


def test_a_bullet_passes_each_rule_once(spark):
    """What a rule looks at is worked out once, however often it says something of it."""
    own = spark.createDataFrame([("x",)], ["t"]).select(W.polished(F.col("t")))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("(?i)\\bon a weekly basis\\b") <= 2


def test_signs_of_fillers_and_spellings_miss_nothing():
    """Where a filler fits, its signs do; the tree of words finds what a list of them by length would."""
    texts = ["he really did", "in order to win", "Utilized it", "utilization of", "a wide variety of", "a number of", "several different", "Various", "x, etc.", "and so on", "and more", "on a daily basis", "on a weekly basis", "with the help of", "in the process of it", "5 percent", "5pct", "5 per cent"]
    for text in texts:
        assert any(re.search(p, text, re.ASCII) for p, _ in W.FILLERS) and re.search(W.FILLER_SIGNS, text, re.ASCII), text
    listed = re.compile("(?i)(?:" + "|".join(re.escape(k) for k in sorted(W.SPELLINGS, key=len, reverse=True)) + r")(?![\w#/-]|\.\w)", re.ASCII)
    tree = re.compile("(?i)" + W.one_of(W.SPELLINGS) + r"(?![\w#/-]|\.\w)", re.ASCII)
    for text in [*W.SPELLINGS, *(f"{a}{b}" for a in W.SPELLINGS for b in (" apis", "s", "script", ".js", "#", " js"))]:
        assert [m.span() for m in tree.finditer(text)] == [m.span() for m in listed.finditer(text)], text
