"""Operators on literal frames, for the cases that the supplied tables lack."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import prose as P
from tallyforge.functions import scalars as S
from tallyforge.operators import aggregates as A
from tallyforge.operators import layout as L
from tallyforge.operators import records as R
from tallyforge.operators import search as X
from tallyforge.operators import sessions as V
from tallyforge.operators import stats as O
from tallyforge.sources import ingest as I
from tallyforge.sources import schemas
from tallyforge.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def hits(spark, *seconds, key=1):
    return spark.createDataFrame([(key, T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)], "k long, ts timestamp_ntz, id long")


def test_session_boundary(spark):
    for last, n in ((1799, 1), (1800, 1), (1801, 2)):
        assert V.sessions(hits(spark, 0, last), "k", "ts").count() == n


def test_rate_limit_is_anchored(spark):
    got = V.rate_limited(hits(spark, 0, 10, 20, 60, 61, 62), "k", "ts", "id", 2, 60).orderBy("id").collect()
    assert [r["count_in_window"] for r in got] == [1, 2, 3, 4, 1, 2]
    assert [r["allowed"] for r in got] == [True, True, False, False, True, True]


def test_zero_fill_and_blank_keys(spark):
    dim = spark.createDataFrame([("a",), ("b",)], "k string")
    rows = spark.createDataFrame([("a",), ("a",), ("z",), (None,), ("",)], "k string")
    assert {tuple(r) for r in A.zero_filled(dim, A.counted(rows, "k"), ["k"], ["n"]).collect()} == {("a", 2), ("b", 0)}
    assert {r["k"] for r in A.without_blank(A.counted(rows, "k"), "k").collect()} == {"a", "z"}


def test_weighted_mean_of_nothing(spark):
    rows = spark.createDataFrame([("ok", None), ("ok", 10.0), ("none", None)], "s string, ms double")
    assert A.weighted_mean(rows, "ms", "s", ["ok", "none"]).first()[0] == 20 / 3
    assert A.weighted_mean(rows, "ms", "s", ["other"]).first()[0] is None


def test_order_statistics(spark):
    rows = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7), ("c", None)], "k string, v int")
    assert {tuple(r) for r in O.upper_median(rows, ["k"], "v").collect()} == {("a", 3), ("b", 7)}
    assert {tuple(r) for r in O.floor_percentile(rows, ["k"], "v", 0.97).collect()} == {("a", 3), ("b", 7)}
    ties = spark.createDataFrame([("a", "x", 2, 5), ("a", "y", 1, 1), ("a", "y", 1, 9)], "k string, v string, w int, seq int")
    assert O.weighted_mode(ties, ["k"], "v", "w", "seq").first()["mode"] == "y"


def test_ranks_of_a_large_group_stand_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE", 20)
    values = {k: [i * i * 7 % 211 for i in range(n)] for k, n in (("a", 400), ("b", 31), (None, 90))}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own] + [("a", None), ("c", None)], "k string, v int")
    counts = rows.filter("v is not null").groupBy("k", "v").agg(F.count("*").alias("__c"))
    parts = O._ranges(counts, ["k"], "v").groupBy("k", "__range").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    assert max(r["n"] for r in parts) < 60 < sum(r["n"] for r in parts if r["k"] == "a")
    own = sorted((r["__range"], r["low"], r["high"]) for r in parts if r["k"] == "a")
    assert all(a[2] < b[1] for a, b in zip(own, own[1:]))
    assert {tuple(r) for r in O.upper_median(rows, ["k"], "v").collect()} == {(k, sorted(v)[len(v) // 2]) for k, v in values.items()}
    for q in (0.0, 0.3, 0.97, 1.0):
        assert {tuple(r) for r in O.floor_percentile(rows, ["k"], "v", q).collect()} == {(k, sorted(v)[int(q * (len(v) - 1))]) for k, v in values.items()}
    assert [tuple(r) for r in O.upper_median(rows, [], "v").collect()] == [(sorted(sum(values.values(), []))[521 // 2],)]


def test_coverage_and_clusters(spark):
    rows = spark.createDataFrame([("a", 0.0, 4.0), ("a", 1.0, 2.0), ("a", 4.0, 5.0), ("a", 8.0, 20.0), ("b", 50.0, 60.0)], "k string, b double, e double")
    assert {tuple(r) for r in O.coverage(rows, ["k"], "b", "e", 0.0, 10.0).collect()} == {("a", 0.7)}
    v = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 9.0, 9.0, 20.0)], "k string, v double")
    assert {(r["first"], r["mean"], r["size"]) for r in O.cluster_values(v, ["k"], "v", 1.0, 2).collect()} == {(1.0, 2.0, 3), (9.0, 9.0, 2)}


def test_running_lines(spark):
    rows = spark.createDataFrame([(1, p, t) for p in range(1, 5) for t in (f"Page {p} of 4", f"body {'abcd'[p - 1]}")], "doc int, page int, line string")
    assert [tuple(r) for r in O.running_lines(rows, "doc", "page", "line").collect()] == [(1, "Page # of #", 4)]


def test_records(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, v string")
    known = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert sorted(map(tuple, R.keep_known(rows, "v", known, "v").collect())) == [(1, "a"), (2, None), (3, None)]
    assert sorted(map(tuple, R.set_null(rows, "v", known, "v").collect())) == [(1, None), (2, "zz"), (3, None)]
    assert {r["id"] for r in R.cascade(rows, "v", known, "v").collect()} == {2, 3}
    assert {r["id"] for r in R.null_preserving(rows, "v", ["a"]).collect()} == {1, 3}
    assert R.null_preserving(rows, "v", []).count() == 3
    bullets = spark.createDataFrame([(1, 0, "Built X."), (1, 1, "built x"), (1, 2, "!!"), (2, 0, "built X")], "o int, pos int, t string")
    assert {(r["o"], r["pos"]) for r in R.first_occurrences(bullets, ["o"], S.norm_key(F.col("t")), ["pos"]).collect()} == {(1, 0), (2, 0)}


def test_inheritance_stops_at_cycles(spark):
    rows = spark.createDataFrame([("a", "b", None), ("b", "c", None), ("c", "a", None), ("d", "e", None), ("e", None, "x")], "id string, parent string, v string")
    assert {(r["id"], r["v"]) for r in R.inherited(rows, "id", "parent", ["v"]).collect()} == {("a", None), ("b", None), ("c", None), ("d", "x"), ("e", "x")}


def test_scalars(spark):
    one = spark.createDataFrame([("<p>a &amp;lt; &copy; &#233;&#x41;</p><script>x</script>b", "é über", -2.5)], "h string, t string, x double")
    row = one.select(S.html_to_text(F.col("h")).alias("h"), S.half_up(F.col("x")).alias("x"), S.capitalise(F.col("t")).alias("c"), S.roman(F.lit(1994)).alias("r"), S.letters(F.lit(28)).alias("l"), S.norm_key(F.lit("A--b  C!")).alias("k"), S.joined("–", F.lit("a"), F.lit(""), F.lit(None), F.lit("b")).alias("j"), S.jurisdiction_label(F.lit("Federal")).alias("f")).first()
    assert row["h"] == "a &lt; &copy; éA\n b" and row["x"] == -2 and row["c"] == "É über"
    assert (row["r"], row["l"], row["k"], row["j"], row["f"]) == ("mcmxciv", "bb", "a b c", "a–b", "the federal courts")


def of_text(spark, change, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["x"] for r in df.select("i", change(F.col("v")).alias("x")).orderBy("i").collect()]


def test_sentences_and_limits(spark):
    said = ["Smith v. Jones was heard. The Acme Co. lost! J. Doe won.", "He said \"no.\" Then (it) ended.  Is it so? 5 yes", "", None]
    assert of_text(spark, P.sentences, said) == [["Smith v. Jones was heard.", "The Acme Co. lost!", "J. Doe won."], ["He said \"no.\"", "Then (it) ended.", "Is it so?", "5 yes"], [], []]
    text = " ".join(f"Sentence number {i} has exactly eight words here." for i in range(30))
    whole, cut, short, none = of_text(spark, P.clamped, [text, "a " * 200, "x  y", None])
    assert len(whole.split()) == 144 and cut == " ".join(["a"] * 150) + "…" and (short, none) == ("x y", "")


def test_keywords(spark):
    text = "The employee was terminated; her wrongful and sudden termination led to damages."
    found = spark.createDataFrame([(text, k) for k in ("wrongful terminated", "copyright", "damage", "", None)], "t string, k string")
    assert [r["x"] for r in found.select(P.appears(P.haystack(F.col("t")), F.col("k")).alias("x")).collect()] == [True, False, True, False, False]
    words = spark.createDataFrame([(text, ["court", "damages", "Damages"], ["termination"]), (text, None, None), (None, ["damages"], [None])], "t string, p array<string>, s array<string>")
    got = [r["x"] for r in P.with_keywords(words.withColumn("h", P.haystack(F.col("t"))), "h", F.col("p"), F.col("s"), ["fraud", "sudden"], "x").collect()]
    assert got == [["damages", "termination", "sudden"], ["sudden"], []]


def test_summaries(spark):
    case = "It was a long case about damages that were claimed by the owner. The court affirmed the judgment below."
    df = spark.createDataFrame([(case, ["damages"]), ("", ["x", "y"]), (None, None)], "t string, s array<string>")
    told = P.summarised(df, "t", F.col("s"), [], F.lit("Tort"), F.lit("Ohio"), F.lit("A v. B was decided.")).collect()
    assert told[0]["keywords"] == ["damages"] and told[0]["summary"] == " ".join(["A v. B was decided.", P.FACT, "“" + case.split(". ")[0] + ".”", P.RULING, "“The court affirmed the judgment below.”", "It may be relevant to your tort matter because the opinion discusses damages, issues that also come up in the situation you described.", P.CLOSING])
    assert told[1]["summary"].startswith(f"A v. B was decided. {P.NO_RULING} It was returned for your search on x and y in Ohio.") and told[2]["keywords"] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab*" ()ANDORT:‘“\n', max_size=60))
def test_sanitised_queries_are_balanced(text):
    q = P.sanitize_query(text)
    assert q == P.sanitize_query(q) and q.count('"') % 2 == 0 and len(q) <= 300
    bare = "w".join(q.split('"')[::2])  # phrases as words
    assert bare.count("(") == bare.count(")") and "()" not in bare


def test_boolean_queries(spark):
    docs = spark.createDataFrame([(1, "Fair use of code"), (2, "use of a patent"), (3, "patents used"), (4, "über use")], "id int, text string")

    def found(q: str) -> set:
        return {r["id"] for r in X.retrieve(docs, "text", q).collect()}

    assert found("use AND NOT patent") == {1, 4} and found('"fair use" OR patent*') == {1, 2, 3} and found("ber") == {4} and found("(code OR patent) use") == {1, 2} and found("") == set()
    assert {r["attempt"] for r in X.first_answer(docs, "text", ["zzz", "code"]).collect()} == {1}


def test_plans(spark):
    terms = [X.Term("eviction", "evict", ("eviction", "evicted")), X.Term("lease", "lease|rent", ("lease",)), X.Term("notice", "notice", ("eviction", "notice to quit")), X.Term("heat", "heat", needs="winter", unless="summer")]
    rows = spark.createDataFrame([(1, "Evicted without notice, my lease ran on"), (2, "no heat in winter"), (3, "nothing")], "id int, t string")
    got = {r["id"]: r for r in X.plan_query(rows, "t", terms, ["tenant", "landlord", "rent"]).collect()}
    assert got[1]["keywords"] == ["eviction", "lease", "notice"] and got[1]["boolean_query"] == "(eviction OR evicted) AND (lease)"
    assert got[2]["keywords"] == ["heat", "tenant", "landlord"] and got[2]["boolean_query"] == "(heat) AND (tenant OR landlord)"
    assert got[3]["boolean_query"] == "(tenant OR landlord) AND (rent)" and got[3]["broad_query"] == "tenant OR landlord OR rent"


def test_ingest(spark):
    bodies = ['{"tool": "pdf-to-word", "status": "success", "inputBytes": 5}', '{"tool": "x", "status": "success", "inputBytes": -1, "errorCode": "A b"}', "not json", "[1]", None]
    rules = [I.Rule("tool", True, tuple(schemas.TOOLS)), I.Rule("status", True, tuple(schemas.STATUSES)), I.Rule("inputBytes", True, low=0, high=2_000_000_000), I.Rule("errorCode", longest=40, pattern="^[a-z0-9_]+$")]
    df = I.checked(I.parsed(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string"), "body", schemas.CONVERSION), rules)
    good, bad = I.split_valid(df)
    assert [r["id"] for r in good.collect()] == [0]
    reasons = {r["id"]: r["reasons"] for r in bad.collect()}
    assert reasons[1] == ["tool", "inputBytes", "errorCode"] and reasons[2][0] == "body" and reasons[3][0] == "body" and 4 in reasons


def test_files(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.pdf").write_bytes(b"nope")
    df = I.docx_text(I.files(spark, str(tmp_path)))
    got = {r["p"]: (r["k"], r["text"]) for r in df.select(F.element_at(F.split("path", "/"), -1).alias("p"), I.file_kind(F.col("content"), F.lit(""), F.col("path")).alias("k"), "text").collect()}
    assert got == {"a.docx": ("docx", "One\ttwo\n\nThree"), "b.pdf": ("pdf", None), "c.pdf": (None, None)}


def test_unsupported_terms_go(spark):
    rows = [(["miranda rights", "search"], '("miranda rights" OR search) AND (police OR miranda*)', "a quarrel"), (["miranda rights"], "miranda AND search", "questioned by police"), ([], None, None)]
    df = spark.createDataFrame(rows, "k array<string>, q string, t string")
    out = X.without_unsupported(df, "k", ["q"], "t", [("miranda", "police", "no police")])
    got = [tuple(r) for r in out.select("k", "q").collect()]
    assert got == [(["search"], "(search) AND (police)"), (["miranda rights"], "miranda AND search"), ([], None)]
    assert X.without_unsupported(df, "k", [], "t", []).select("k").collect() == df.select("k").collect()


def test_word_files_as_blocks_and_styles(spark):
    import io
    import zipfile

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="H"/><w:jc w:val="center"/></w:pPr><w:r><w:t>Title</w:t><w:tab/></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr><w:pageBreakBefore/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    sheet = '<w:style w:styleId="N"><w:rPr><w:rFonts w:ascii="Arial"/><w:sz w:val="22"/></w:rPr></w:style><w:style w:styleId="H"><w:basedOn w:val="N"/><w:rPr><w:b/></w:rPr></w:style>'
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {space}>{sheet}</w:styles>")
    df = I.docx_parts(spark.createDataFrame([(1, bytearray(file.getvalue())), (2, bytearray(b"x")), (3, None)], "i int, content binary")).cache()
    one, *others = df.orderBy("i").collect()
    assert [tuple(b) for b in one["blocks"]] == [(0, "H", None, None, "center", False, False, "Title\t"), (1, None, "4", 1, None, True, False, "item"), (2, None, None, None, None, False, True, "cell")]
    assert all(o["blocks"] is None and o["styles"] is None for o in others)
    styles = df.select(F.explode("styles").alias("s")).select("s.*")
    got = {r["id"]: (r["font"], r["size"], r["bold"]) for r in R.inherited(styles, "id", "parent", ["font", "size", "bold"]).collect()}
    assert got == {"N": ("Arial", 11.0, None), "H": ("Arial", 11.0, True)}


def test_inheritance_of_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None, "root" if i == 0 else None) for i in range(100)] + [(200, 201, None), (201, 200, "c"), (300, 999, None)]
    got = {r["id"]: r["v"] for r in R.inherited(spark.createDataFrame(rows, "id int, parent int, v string"), "id", "parent", ["v"]).collect()}
    assert all(got[i] == "root" for i in range(100)) and got[200] == got[201] == "c" and got[300] is None


def test_assembled_lines_match_a_plain_version(spark):
    import random

    rng = random.Random(4)
    rows = [(d, 0, i, float(rng.randint(0, 60)), rng.choice([10.0, 12.0, 13.0, 30.0, 31.0]), float(rng.randint(2, 9)), rng.choice([6.0, 10.0])) for d in range(4) for i in range(40)]
    got = {(r["doc"], r["seq"]): r["line"] for r in L.lines_of_glyphs(spark.createDataFrame(rows, "doc int, page int, seq int, x double, y double, w double, size double")).collect()}
    for d in range(4):
        lines: list = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[4], r[3], r[2])):
            fits = [n for n, own in enumerate(lines) if abs(max(own, key=lambda g: g[6])[4] - r[4]) <= max(1.5, 0.42 * max(max(g[6] for g in own), r[6])) and not any(r[3] < g[3] + g[5] - 1 and g[3] < r[3] + r[5] - 1 for g in own)]
            n = fits[0] if fits else len(lines)
            lines[n:] = lines[n:] or [[]]
            lines[n].append(r)
            assert got[(d, r[2])] == n


def test_rate_limits_of_a_hot_key(spark):
    hits = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id"), F.timestamp_seconds(F.expr("id div 10")).alias("ts"))
    got = V.rate_limited(hits, "k", "ts", "id", 5, 60).agg(F.count("*").alias("n"), F.max("count_in_window").alias("most"), F.countDistinct("window_start").alias("w")).first()
    assert (got["n"], got["most"], got["w"]) == (200_000, 610, 328)


def test_json_ld(spark):
    rows = spark.createDataFrame([(2, "B", "/b", False), (1, "A", "/a", True)], "o int, n string, u string, live boolean")
    assert I.to_list(I.json_ld(rows, "n", "u", "o")).first()["json"] == '{"@type":"ItemList","itemListElement":[{"@type":"ListItem","position":1,"name":"A","url":"/a"},{"@type":"ListItem","position":2,"name":"B","url":"/b"}]}'
    made = I.stamped(rows).collect()
    assert len({r["id"] for r in made}) == 2 and all(r["created_at"] for r in made)
    assert {tuple(r) for r in I.site_map(rows, "u", "live", "https://s").collect()} == {("https://s/a", 0.9), ("https://s/b", 0.6)}


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = hits(spark, 0, 100, 4000, 4100, 90_000, 90_001, 400_000)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = streams.source(spark, str(tmp_path / "in"), "k long, ts timestamp_ntz, id long", "ts")
    closed = {(r["started"], r["hits"]) for r in run(streams.sessions(src, "k", "ts"), "s1").collect()}
    batch = {(r["started"], r["hits"]) for r in V.sessions(rows, "k", "ts").collect()}
    assert closed < batch and len(batch - closed) == 1
    assert {r["n"] for r in run(streams.daily_counts(src, "ts"), "s2").collect()} == {4, 2}
    assert run(streams.once(src, "id", "ts"), "s3").count() == 7
    limited = run(streams.rate_limited(src, "k", "ts", "id", 1, 150), "s4")
    expected = V.rate_limited(rows, "k", "ts", "id", 1, 150)
    assert {(r["id"], r["allowed"]) for r in limited.collect()} == {(r["id"], r["allowed"]) for r in expected.collect()}
    streams.write_batches(src, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Limits and rests hold over files that arrive after the query was stopped; a group's state goes once its time has passed."""
    schema = "k long, ts timestamp_ntz, id long, out boolean"
    rows = [(1, 0, 1, True), (1, 600, 2, False), (2, 10, 3, False), (1, 1199, 4, True), (1, 1200, 5, False), (2, 1300, 6, True), (1, 1300, 7, False), (2, 2000, 8, True), (2, 2500, 9, False), (3, 90_000, 10, False), (2, 90_100, 11, False), (1, 90_200, 12, True)]
    frame = lambda own: spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), i, out) for k, s, i, out in own], schema)
    limited, rests = {}, {}
    for n, part in enumerate((rows[:4], rows[4:7], rows[7:])):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = streams.source(spark, str(tmp_path / "in"), schema, "ts")
        for name, stream, into in (("limits", streams.rate_limited(src, "k", "ts", "id", 2, 700), limited), ("rests", streams.cooled_down(src, "k", "ts", "id", "out", 20), rests)):
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp-{name}")).option("path", str(tmp_path / name)).trigger(availableNow=True).start()
            q.awaitTermination()
            into.clear()
            into.update({r["id"]: r[-1] for r in spark.read.parquet(str(tmp_path / name)).collect()})
            assert len(into) == sum(map(len, (rows[:4], rows[4:7], rows[7:])[: n + 1]))
    assert limited == {r["id"]: r["allowed"] for r in V.rate_limited(frame(rows), "k", "ts", "id", 2, 700).collect()}
    assert rests == {r["id"]: r["resting"] for r in V.cooled_down(frame(rows), "k", "ts", "id", "out").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: False, 10: False, 11: False, 12: False}


def test_condensed_texts_keep_a_last_word_before_a_line_end(spark):
    """The head ends with a line: its last word is whole, and only the line end goes."""
    text = "one two three\n" + "x " * 20 + "end of it"
    (row,) = spark.createDataFrame([(text,)], ["t"]).select(S.condense(F.col("t"), 14, 8, 0, " [...] ")).collect()
    assert row[0] == "one two three [...] of it"


def jobs_of(spark, run) -> int:
    """How many Spark jobs a call runs."""
    group = f"jobs-{dt.datetime.now().timestamp()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_components_of_a_chain_take_no_rounds(spark):
    """Chains, rings, loops, repeated links and links to nothing; the same by rounds, which huge pages take."""
    n = 200
    nodes = spark.createDataFrame([(d, 0, i) for d in (1, 2) for i in range(n)] + [(3, 0, 7), (None, 0, 1), (None, 0, 2)], "doc int, page int, id int")
    links = [(1, 0, i + 1, i) for i in range(n - 1) if i != 100] + [(2, 0, i, i + 2) for i in range(n - 2)] * 2 + [(2, 0, 5, 5), (3, 0, 7, 8), (None, 0, 1, 2)]
    links = spark.createDataFrame(links, "doc int, page int, a_id long, b_id long")
    expected = sorted([(1, 0, i, 0 if i <= 100 else 101) for i in range(n)] + [(2, 0, i, i % 2) for i in range(n)] + [(3, 0, 7, 7), (-1, 0, 1, 1), (-1, 0, 2, 2)])
    out = []
    assert jobs_of(spark, lambda: out.extend(L.components(nodes, links).fillna(-1, ["doc"]).collect())) <= 8
    assert sorted(map(tuple, out)) == expected
    assert sorted(map(tuple, L.components(nodes, links, most=100).fillna(-1, ["doc"]).collect())) == expected


def test_keyword_presence_makes_a_haystack_once(spark):
    own = spark.createDataFrame([("Licensed UNDER “a” licence’s\u2003terms",), (None,)], ["t"])
    assert [r[0] for r in own.select(P.haystack(F.col("t"))).collect()] == [" licensed under a licence's terms ", "  "]
    asked = own.select(P.appears(P.haystack(F.col("t")), F.lit("licensed under license")).alias("p"))
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("lower(coalesce(t#") == 1
    assert [r[0] for r in asked.collect()] == [True, False]


def test_lines_of_glyphs_take_no_call_a_page(spark):
    glyphs = spark.createDataFrame([(d, 0, s, 10.0 * s, 0.0 if s < 2 else 50.0, 8.0, 10.0) for d in (1, 2) for s in range(4)], "doc int, page int, seq int, x double, y double, w double, size double")
    lined = L.lines_of_glyphs(glyphs)
    assert sorted((r.doc, r.seq, r.line) for r in lined.collect()) == [(d, s, s // 2) for d in (1, 2) for s in range(4)]
    assert "FlatMapGroups" not in lined._jdf.queryExecution().optimizedPlan().toString()
