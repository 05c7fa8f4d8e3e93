"""Operators on nested résumé records (the struct of functions.rewriting.RESUME) and their layout as blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string

from ..functions.rewriting import RESUME, bind, parsed_resumes, polished, polished_summary, spelled
from ..functions.scalars import joined, norm_key

SECTIONS = ["summary", "experience", "projects", "skills", "education", "certifications"]
#: The order of sections, the headings, whether clients are named, and the lines of the header, by template.
TEMPLATES = {
    "full-time": {
        "sections": ["summary", "experience", "projects", "skills", "education", "certifications"],
        "summary": "Professional Summary", "experience": "Professional Experience", "skills": "Technical Skills",
        "client": False, "extras": ["{relocation}"],
    },
    "w2": {
        "sections": ["summary", "skills", "experience", "projects", "education", "certifications"],
        "summary": "Summary", "experience": "Project Experience", "skills": "Technical Skills",
        "client": True, "extras": ["Work Authorization: {workAuthorization}", "Availability: {availability}", "{relocation}", "Open to W2 Contract"],
    },
    "c2c": {
        "sections": ["skills", "summary", "experience", "projects", "certifications", "education"],
        "summary": "Consultant Profile", "experience": "Client Engagements", "skills": "Technical Skills Matrix",
        "client": True, "extras": ["Corp-to-Corp via {corpName}", "Work Authorization: {workAuthorization}", "Availability: {availability}", "{relocation}"],
    },
}
#: Headings that all templates share.
HEADINGS = {"projects": "Key Projects", "education": "Education", "certifications": "Certifications"}


def heading(template: str, section: str) -> str:
    return TEMPLATES[template].get(section) or HEADINGS[section]


def header_extras(template: str, engagement: Column) -> Column:
    """Lines of the header from a struct of facts; a line whose fact is empty or null is left out."""
    lines = []
    for line in TEMPLATES[template]["extras"]:
        before, _, rest = line.partition("{")
        fact = F.coalesce(F.trim(engagement[rest.rstrip("}")]), F.lit("")) if rest else F.lit("stated")
        lines.append(F.when(fact != "", F.concat(F.lit(before), fact) if rest else F.lit(line)))
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def optimised(r: Column) -> Column:
    """struct(record, changed): a record with polished summary, bullets and spellings, and how many bullets that changed.

    Bullets and skills that say the same as an earlier one of their list go.
    """

    def bullets(own: Column) -> Column:
        told = F.transform(F.filter(own, lambda b: F.trim(b) != ""), lambda b: bind(polished(b), lambda p: F.struct(p.alias("text"), norm_key(p).alias("key"), (norm_key(p) != norm_key(b)).alias("changed"))))
        return told

    def firsts(told: Column) -> Column:
        kept = bind(F.transform(told, lambda x: x["key"]), lambda keys: F.filter(told, lambda x, i: (x["key"] != "") & (F.array_position(keys, x["key"]) == i + 1)))
        return F.transform(kept, lambda x: x["text"])

    def skills(items: Column) -> Column:
        own = F.transform(items, lambda i: spelled(F.trim(i)))
        return bind(own, lambda x: bind(F.transform(x, lambda i: F.lower(i)), lambda low: F.filter(x, lambda i, at: (i != "") & (F.array_position(low, F.lower(i)) == at + 1))))

    def of(told: Column) -> Column:
        jobs = F.zip_with(r["experience"], told["jobs"], lambda e, t: e.withField("bullets", firsts(t)))
        projects = F.zip_with(r["projects"], told["projects"], lambda p, t: p.withField("bullets", firsts(t)))
        groups = F.transform(r["skills"], lambda g: g.withField("items", skills(g["items"])))
        every = F.concat(F.flatten(told["jobs"]), F.flatten(told["projects"]))
        record = r.withField("summary", polished_summary(r["summary"])).withField("experience", jobs).withField("projects", projects).withField("skills", groups)
        return F.struct(record.alias("record"), F.size(F.filter(every, lambda x: x["changed"])).alias("changed"))

    told = F.struct(F.transform(r["experience"], lambda e: bullets(e["bullets"])).alias("jobs"), F.transform(r["projects"], lambda p: bullets(p["bullets"])).alias("projects"))
    return bind(told, of)


def enough(r: Column) -> Column:
    """Whether a record has a name, or a job with a role or company."""
    return (F.trim(r["name"]) != "") | F.exists(r["experience"], lambda e: (F.trim(e["role"]) != "") | (F.trim(e["company"]) != ""))


def has_content(r: Column, section: str) -> Column:
    if section == "summary":
        return F.trim(r["summary"]) != ""
    if section == "skills":
        return F.exists(r["skills"], lambda s: F.size(s["items"]) > 0)
    if section == "experience":
        return F.exists(r["experience"], lambda e: (e["role"] != "") | (e["company"] != "") | (F.size(e["bullets"]) > 0))
    if section == "education":
        return F.exists(r["education"], lambda e: (e["school"] != "") | (e["degree"] != ""))
    if section == "projects":
        return F.exists(r["projects"], lambda p: p["name"] != "")
    return F.exists(r[section], lambda c: F.trim(c) != "")


def cleaned(skills: Column) -> Column:
    """Skill groups with trimmed items; groups without any go."""
    items = lambda g: F.filter(F.transform(g["items"], lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(skills, lambda g: F.struct(F.trim(g["category"]).alias("category"), items(g).alias("items"))), lambda g: F.size(g["items"]) > 0)


def blocks(df: DataFrame, record: str, key: str, template: str = "full-time") -> DataFrame:
    """(key, section_ord, item_ord, sub_ord, kind, text): a record as an ordered list of blocks by a template; empty
    sections give none. Each record's blocks are made as one array, so df is read once."""
    shape, r = TEMPLATES[template], F.col(record)
    block = lambda item, sub, kind, text: F.struct(item.cast("int").alias("item_ord"), sub.cast("int").alias("sub_ord"), F.lit(kind).alias("kind"), text.alias("text"))
    zero, none = F.lit(0), F.lit(-1)
    span = lambda x: joined(" – ", x["start"], x["end"])

    def entries(items: Column, title, bullets: bool) -> Column:
        own = lambda x, i: F.array(block(i, none, "entry", title(x)))
        rows = F.transform(items, lambda x, i: F.concat(own(x, i), F.transform(x["bullets"], lambda b, j: block(i, j, "bullet", b))) if bullets else own(x, i))
        return F.flatten(rows)

    client = lambda e: F.when(e["client"] != "", F.concat(F.lit("Client: "), e["client"])) if shape["client"] else F.lit(None).cast("string")
    bodies = {
        "summary": F.array(block(zero, zero, "para", r["summary"])),
        "experience": entries(r["experience"], lambda e: joined(" | ", e["role"], e["company"], client(e), span(e)), True),
        "projects": entries(r["projects"], lambda p: p["name"], True),
        "skills": F.transform(cleaned(r["skills"]), lambda g, i: block(i, zero, "para", F.concat(g["category"], F.lit(": "), F.array_join(g["items"], ", ")))),
        "education": entries(r["education"], lambda e: joined(", ", e["school"], e["degree"], e["field"], span(e)), False),
        "certifications": F.transform(r["certifications"], lambda c, i: block(i, zero, "bullet", c)),
    }
    def numbered(at: int, section: str) -> Column:
        rows = F.concat(F.array(block(none, none, "heading", F.lit(heading(template, section)))), bodies[section])
        told = F.transform(rows, lambda x: F.struct(F.lit(at).alias("section_ord"), x.alias("x")))
        return F.when(has_content(r, section), told).otherwise(F.slice(told, 1, 0))

    parts = [numbered(at, section) for at, section in enumerate(shape["sections"])]
    told = df.select(key, F.explode(F.flatten(F.array(*parts))).alias("b"))
    return told.select(key, "b.section_ord", "b.x.*")


def break_line(widths: list[float], space: float, full: float, shrink: float = 0.25) -> list[tuple[int, int, float]]:
    """(first word, end, gap) of each line: words are added while they fit with spaces shrunk by `shrink` at the most; gaps fill the line but for the last one."""
    out, first, total = [], 0, 0.0
    for i, w in enumerate(widths):
        if i > first and total + w + (i - first) * space * (1 - shrink) > full:
            out.append((first, i, (full - total) / (i - first - 1) if i - first > 1 else space))
            first, total = i, 0.0
        total += w
    return [*out, (first, len(widths), space)] if widths else out


def broken(space: float, full: float):
    """UDF: array of word widths -> lines (first, end, gap)."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("gap", T.DoubleType())])))
    def run(widths: pd.Series) -> pd.Series:
        return widths.map(lambda w: [dict(zip(("first", "end", "gap"), x)) for x in break_line(list(w), space, full)])

    return run


class Unavailable(Exception):
    """What a provider raises when it can't answer now."""


def asked(providers: list, kind: str, needed: list[str], attempts: int = 2, failures: int = 3, rest: int = 20):
    """UDF: text -> struct of `kind`, or null where no provider gives one.

    A provider is called with (text, problem) and returns a dict. An answer that lacks a `needed` field is sent back once
    with the problem named. A provider that raises Unavailable is tried `attempts` times; the next one then takes over, and
    after `failures` such texts in a row it rests for `rest` texts of its task. Other exceptions are faults and end the job.
    """
    names = [f.name for f in _parse_datatype_string(kind).fields]

    def answer(provider, text: str) -> dict | None:
        problem = None
        for _ in range(2):
            got = provider(text, problem)
            missing = [n for n in needed if not (got or {}).get(n)]
            if not missing:
                return {n: got.get(n) for n in names}
            problem = "missing: " + ", ".join(missing)
        return None

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        failed, resting = [0] * len(providers), [0] * len(providers)
        for texts in batches:
            rows = []
            for text in texts:
                got = None
                for i, provider in enumerate(providers):
                    if resting[i]:
                        resting[i] -= 1
                        continue
                    for _ in range(attempts):
                        try:
                            got, failed[i] = answer(provider, text or ""), 0
                            break
                        except Unavailable:
                            failed[i] += 1
                    if failed[i] >= failures * attempts:
                        failed[i], resting[i] = 0, rest
                    if got:
                        break
                rows.append(got or dict.fromkeys(names))
            yield pd.DataFrame(rows, columns=names)

    return run


def structured(df: DataFrame, text: str, key: str, providers: list | None = None, needed: list[str] | None = None, name: str = "record") -> DataFrame:
    """Add a record (RESUME): from outside models where one answers, else from the rules. Without providers the rules do it all."""
    ruled = parsed_resumes(df, text, key, name)
    if not providers:
        return ruled
    needed = needed or ["name"]
    told = ruled.withColumn("__told", asked(providers, RESUME, needed)(F.col(text)))
    return told.withColumn(name, F.when(F.col("__told")[needed[0]].isNotNull(), F.col("__told")).otherwise(F.col(name))).drop("__told")
