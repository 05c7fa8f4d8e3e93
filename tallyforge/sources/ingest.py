"""Validated ingest: JSON bodies are parsed with a declared schema and split into rows to store and rows to refuse."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.layout import checkpointed


@dataclass(frozen=True)
class Rule:
    """What a field must meet. A missing field is refused only if required."""

    field: str
    required: bool = False
    members: tuple[str, ...] = ()
    low: int | None = None
    high: int | None = None
    longest: int | None = None
    pattern: str | None = None

    def failed(self) -> Column:
        c, bad = F.col(self.field), F.lit(False)
        if self.members:
            bad = bad | ~c.isin(*self.members)
        if self.low is not None:
            bad = bad | (c < self.low)
        if self.high is not None:
            bad = bad | (c > self.high)
        if self.longest is not None:
            bad = bad | (F.length(c) > self.longest)
        if self.pattern is not None:
            bad = bad | ~c.rlike(self.pattern)
        return F.when(c.isNull(), F.lit(self.required)).otherwise(F.coalesce(bad, F.lit(False)))


def parsed(df: DataFrame, body: str, schema: str) -> DataFrame:
    """The fields of a JSON body; is_json is false where it isn't an object of that shape."""
    return df.withColumn("__p", F.from_json(body, schema + ", __broken string", {"columnNameOfCorruptRecord": "__broken", "mode": "PERMISSIVE"})).withColumn("is_json", F.col("__p").isNotNull() & F.col("__p.__broken").isNull() & F.col(body).rlike(r"^\s*\{")).select(*df.columns, "is_json", *[F.col(f"__p.{c.strip().split()[0]}") for c in schema.split(",")])


def checked(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add reasons: the fields that break a rule, in rule order."""
    own = [F.when(r.failed(), F.lit(r.field)) for r in rules]
    broken = F.when(~F.col("is_json"), F.lit("body")) if "is_json" in df.columns else F.lit(None).cast("string")
    return df.withColumn("reasons", F.array_compact(F.array(broken, *own)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows to refuse)."""
    return df.filter(F.size("reasons") == 0), df.filter(F.size("reasons") > 0)


def serialised(value: Column, most: int = 2000) -> Column:
    """A struct or map as JSON text of `most` characters at the most; a longer one is cut, and no longer JSON."""
    return F.substring(F.to_json(value), 1, most)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def file_kind(content: Column, mime: Column, name: Column) -> Column:
    """pdf or docx by type or suffix, if the content starts with that kind's magic bytes; else null."""
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    low = F.lower(name)
    said = F.when((mime == "application/pdf") | low.endswith(".pdf"), "pdf").when((mime == word) | low.endswith(".docx"), "docx")
    head = F.hex(F.substring(content, 1, 4))
    return F.when((said == "pdf") & (head == "25504446"), "pdf").when((said == "docx") & head.startswith("504B"), "docx")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a path."""
    return spark.read.format("binaryFile").load(path)


def _docx_text(content: bytes | None) -> str | None:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as package:
            root = ElementTree.fromstring(package.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    paragraphs = []
    for p in root.iter(f"{space}p"):
        parts = [{"t": x.text or "", "tab": "\t", "br": "\n"}.get(x.tag.removeprefix(space), "") for x in p.iter()]
        paragraphs.append("".join(parts))
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(paragraphs)).strip()


def docx_text(df: DataFrame, content: str = "content", name: str = "text") -> DataFrame:
    """Add the plain text of Word files, paragraphs parted by empty lines; null where the bytes are no such file."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(_docx_text)

    return df.withColumn(name, text(content))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "array<struct<seq: int, style: string, list: string, level: int, align: string, page_break: boolean, in_table: boolean, text: string>>"
STYLES = "array<struct<id: string, parent: string, font: string, size: double, bold: boolean, align: string>>"


def _value(node, *steps: str) -> str | None:
    for step in steps:
        node = None if node is None else node.find(f"{_WORD}{step}")
    return None if node is None else node.get(f"{_WORD}val", "1")


def _docx_blocks(root) -> list[tuple]:
    inside = {id(p) for t in root.iter(f"{_WORD}tbl") for p in t.iter(f"{_WORD}p")}
    out = []
    for seq, p in enumerate(root.iter(f"{_WORD}p")):
        props = p.find(f"{_WORD}pPr")
        parts = [{"t": x.text or "", "tab": "\t", "br": "\n"}.get(x.tag.removeprefix(_WORD), "") for x in p.iter()]
        level = _value(props, "numPr", "ilvl")
        out.append((seq, _value(props, "pStyle"), _value(props, "numPr", "numId"), None if level is None else int(level), _value(props, "jc"), _value(props, "pageBreakBefore") not in (None, "0", "false"), id(p) in inside, "".join(parts)))
    return out


def _docx_styles(root) -> list[tuple]:
    out = []
    for s in root.iter(f"{_WORD}style"):
        run = s.find(f"{_WORD}rPr")
        font = None if run is None else run.find(f"{_WORD}rFonts")
        size, bold = _value(run, "sz"), _value(run, "b")
        out.append((s.get(f"{_WORD}styleId"), _value(s, "basedOn"), None if font is None else font.get(f"{_WORD}ascii"), None if size is None else float(size) / 2, None if bold is None else bold not in ("0", "false"), _value(s, "pPr", "jc")))
    return out


def docx_parts(df: DataFrame, content: str = "content") -> DataFrame:
    """Add blocks and styles of Word files: paragraphs in order with style, list, level, alignment and text, and the style
    sheet with each style's parent, which operators.records.inherited resolves. Null where the bytes are no such file."""

    def read(data: bytes | None, name: str, parse):
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as package:
                return parse(ElementTree.fromstring(package.read(name)))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    @F.pandas_udf(BLOCKS)
    def blocks(column: pd.Series) -> pd.Series:
        names = ("seq", "style", "list", "level", "align", "page_break", "in_table", "text")
        found = [read(x, "word/document.xml", _docx_blocks) for x in column]
        return pd.Series([None if b is None else [dict(zip(names, x)) for x in b] for b in found], dtype=object)

    @F.pandas_udf(STYLES)
    def styles(column: pd.Series) -> pd.Series:
        names = ("id", "parent", "font", "size", "bold", "align")
        found = [read(x, "word/styles.xml", _docx_styles) for x in column]
        return pd.Series([None if b is None else [dict(zip(names, x)) for x in b] for b in found], dtype=object)

    return df.withColumn("blocks", blocks(content)).withColumn("styles", styles(content))


def json_ld(df: DataFrame, name: str, url: str, order: str) -> DataFrame:
    """(position, json): a JSON-LD item for each row, positions from 1. Sorted ranges are numbered by themselves and start
    after those before; to_list() puts items into one document for a page of them."""
    rows = checkpointed(df.select(name, url, order).repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = F.broadcast(sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    placed = rows.join(starts, "__part").withColumn("position", F.col("__start") + F.col("__id") - F.col("__first") + 1)
    item = F.struct(F.lit("ListItem").alias("@type"), F.col("position"), F.col(name).alias("name"), F.col(url).alias("url"))
    return placed.select("position", F.to_json(item).alias("json"))


def to_list(items: DataFrame, first: int = 1, size: int = 100) -> DataFrame:
    """One row: `size` items from position `first` on as a JSON-LD list."""
    page = items.filter(F.col("position").between(first, first + size - 1))
    own = page.agg(F.array_sort(F.collect_list(F.struct("position", "json"))).alias("x"))
    return own.select(F.concat(F.lit('{"@type":"ItemList","itemListElement":['), F.array_join(F.transform("x", lambda r: r["json"]), ","), F.lit("]}")).alias("json"))


def stamped(df: DataFrame, key: str = "id", ts: str = "created_at") -> DataFrame:
    """Rows with a random key and the time of the load, where they lack them. Both differ from run to run: for loads, not for queries."""
    made = {key: F.uuid(), ts: F.current_timestamp()}
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in made.items()})


def site_map(df: DataFrame, path: str, active: str, site: str) -> DataFrame:
    return df.select(F.concat(F.lit(site), F.col(path)).alias("url"), F.when(F.col(active), 0.9).otherwise(0.6).alias("priority"))


