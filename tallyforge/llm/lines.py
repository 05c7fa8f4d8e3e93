"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its words. It goes if an earlier line, by (doc_id, place), has a Jaccard similarity of the threshold
or more with it, whether or not that line stays itself. Sets are ordered by how rare their words are; similar sets then
share a word among their first few (prefix filter), not too far back (positional filter), and have similar sizes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, bucketed, forget, materialise

#: Bits of a word's hash that stay below its rarity class in a word's key.
HASH_BITS = 57
#: Words of this class and above (8: 256 lines or more share them) are looked up in pairs; the class rises with the documents.
HOT_CLASS = 8
#: Sets of up to so many words are looked up by pairs of hot words, larger ones by each hot word, so that a set has eight
#: postings for each of its words at the most.
PAIRED = 400
THRESHOLD = Fraction(4, 5)
#: Keys of more sets than this are looked at by slices first, and so many of the nearest sets found there are tried: this
#: decides on speed, not on results.
LARGE, SLICES, TRIED = 16, 24, 16
#: Sets are looked at by slices if they are this near to the earliest set of their key, as variants of one line are and lines
#: that share a word by chance are not: this decides on speed, too.
NEAR = 2
#: Postings are made in so many turns, by their keys, so that the shuffle of a part of them stands on disk at once.
TURNS = 2
#: Where a line stands, in the order of lines: row is told in identified().
PLACE = ("doc_id", "row", "line_no")
#: The place of the earlier line that a line is similar to.
OF = ("of_doc", "of_row", "of_line")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): row tells rows apart that share a doc_id, by a hash of their text; it is 0 where the id is alone.

    Rows that are equal in doc_id and text are one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = materialise(rows.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("r_doc"), F.lit(1).alias("r_many")), "shared-ids")
    if shared.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    joined = rows.join(broadcast_if_small(shared, 1_000_000), F.col("doc_id").eqNullSafe(F.col("r_doc")), "left")
    return joined.select("doc_id", F.when(F.col("r_many") == 1, F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("row"), "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, words): the lines of identified docs that have a word, with their words as they come."""
    rows = docs.select("doc_id", "row", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "row", "line_no", words_of(F.col("line")).alias("words")).filter(F.size("words") > 0)


def spaced(text: Column) -> Column:
    """The other separators of words as spaces, in the few texts that have any: translate looks at each character."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | text.contains(c)
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def words_of(line: Column) -> Column:
    """Words between spaces; the empty ones between two spaces are taken out where there are such."""
    cut = F.split(line, " ")
    return F.when(line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == ""), F.array_remove(cut, "")).otherwise(cut)


def rarity(docs: DataFrame, bits: int | None = None) -> tuple[bytes, int]:
    """(table, bits): for each value of the low bits of a word's hash, the binary logarithm of its words' occurrences.

    A rare word that shares its slot with a frequent one counts as frequent, which costs speed but no result. The table's
    size grows with the number of documents up to 4 MB, and goes with each task.
    """
    if bits is None:
        bits = min(22, max(12, math.ceil(math.log2(docs.count() + 1)) + 2))
    words = docs.select(F.explode(F.split(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w != ''")
    block = 1 << (bits // 2)
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")).agg(F.count("*").alias("n"))
    levels = counts.select("slot", F.least(F.floor(F.log2("n")), F.lit(31)).cast("int").alias("level")).filter("level > 0")
    letter = F.struct((F.col("slot") % block).cast("int").alias("at"), F.col("level").cast("tinyint").alias("level"))
    packed = levels.groupBy(F.expr(f"slot div {block}").alias("block")).agg(F.collect_list(letter).alias("own"))
    spelled = F.array_join(F.transform("own", lambda x: F.concat(F.lpad(F.hex(x["at"]), 4, "0"), F.lpad(F.hex(x["level"]), 2, "0"))), "")
    table = bytearray(1 << bits)
    for row in packed.select("block", F.unhex(spelled).alias("own")).toLocalIterator():
        base, own = row["block"] * block, row["own"]
        for i in range(0, len(own), 3):
            table[base + own[i] * 256 + own[i + 1]] = own[i + 2]
    return bytes(table), bits


def keys_of(words: Column, table: bytes, bits: int) -> Column:
    """The distinct words' keys, rarest first: class above, hash below. One order for all lines."""
    level = F.lit(table)

    def key(h: Column) -> Column:
        known = F.ascii(F.substring(level, (h.bitwiseAND(F.lit((1 << bits) - 1)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.shiftleft(known.cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    return F.sort_array(F.array_distinct(F.transform(F.transform(words, lambda w: F.xxhash64(w)), key)))


def keyed_lines(lines: DataFrame, table: bytes, bits: int, least: Fraction) -> DataFrame:
    """(place, h1, h2, n, p1, p2, prefix): what the join needs of each line. p1 and p2 have 128 bits, each the parity of the words that seven bits of their keys send there."""
    a, b = least.numerator, least.denominator
    rows = lines.select(*PLACE, keys_of(F.col("words"), table, bits).alias("keys"))
    n = F.size("keys")

    def parity(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate("keys", F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    # of all words, and of those of the second half; the rest is the first half's
    rows = rows.select("*", parity(lambda k: F.lit(1).cast("long")).alias("p"), parity(lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("long"))).alias("p2"))

    size = F.expr(f"size(keys) - ({a} * size(keys) + {b - 1}) div {b} + 2").cast("int")
    return rows.select(*PLACE, F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit("second"), F.col("keys")).alias("h2"), n.alias("n"), F.col("p").bitwiseXOR(F.col("p2")).alias("p1"), "p2", F.slice("keys", F.lit(1), F.least(n, size)).alias("prefix"))


def postings(sets: DataFrame, least: Fraction, hot_class: int) -> DataFrame:
    """(key, sid, n, pos, p1, p2): where to look a set up. p1 and p2 are the parities of its words from pos on.

    By each word of its prefix that isn't hot, but for those of class 0, which stand once in all documents, and by each pair of hot ones in the prefix with one more word. If the rarest
    word that two similar sets share is hot, so is the second, and both stand there; they share two, as sets that share one
    word only are equal or less than half alike. Pairs grow with the square of the prefix, so sets of more than PAIRED words go by
    single words all through; smaller ones that can be similar to such a set do both.
    """
    a, b = least.numerator, least.denominator
    hot = hot_class << HASH_BITS
    out = sets.withColumn("p", F.expr(f"cast(n - ({a}L * n + {b - 1}) div {b} + 1 as int)"))
    out = out.withColumn("cold", F.size(F.filter("prefix", lambda k: k < hot)))
    out = out.withColumn("single", F.expr(f"if({b}L * n > {a}L * {PAIRED}, p, least(p, cold))"))
    out = out.withColumn("alone", F.size(F.filter("prefix", lambda k: k < 1 << HASH_BITS)))
    singles = "transform(sequence(alone + 1, single), i -> named_struct('key', element_at(prefix, i), 'pos', i - 1))"
    pairs = "flatten(transform(sequence(cold + 1, size(prefix) - 1), i -> transform(sequence(i + 1, size(prefix)), j -> named_struct('key', xxhash64(element_at(prefix, i), element_at(prefix, j)), 'pos', i - 1))))"
    none = "cast(array() as array<struct<key: bigint, pos: int>>)"
    for side, bit in (("r1", "shiftright(k, 6) & 1L ^ 1L"), ("r2", "shiftright(k, 6) & 1L")):
        # the parity from each place of the prefix on
        step = f"array_append(r, element_at(r, -1) ^ shiftleft({bit}, cast(k & 63 as int)))"
        out = out.withColumn(side, F.expr(f"aggregate(prefix, array({side.replace('r', 'p')}), (r, k) -> {step})"))
    entry = F.expr(f"concat(if(single > alone, {singles}, {none}), if(n <= {PAIRED} and size(prefix) - cold > 1, {pairs}, {none}))")
    out = out.select("sid", "n", "r1", "r2", F.explode(entry).alias("e"))
    p1, p2 = (F.get(r, F.col("e.pos")) for r in ("r1", "r2"))
    return out.select("e.key", "sid", "n", "e.pos", p1.alias("p1"), p2.alias("p2"))


def _alike(x: str, y: str, least: Fraction) -> Column:
    """Whether sets x and y can be similar by sizes and parities: words that one of them lacks flip a bit of the parity each."""
    a, b = least.numerator, least.denominator
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return _sizes(x, y, least) & ((a + b) * _apart(x, y) <= (b - a) * (nx + ny))


def _sizes(x: str, y: str, least: Fraction) -> Column:
    a, b = least.numerator, least.denominator
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (b * nx >= a * ny) & (b * ny >= a * nx)


def _apart(x: str, y: str) -> Column:
    """Bits in which the parities of two sets differ."""
    bits = [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in ("p1", "p2")]
    return bits[0] + bits[1]


def _differ(x: str, y: str) -> Column:
    """How many words two postings of a key, the first one that their sets share, have in one set only, at the least: those
    before it, and what the sizes and parities of the rest tell."""
    nx, ny, px, py = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    return px + py + F.greatest(_apart(x, y), F.abs((nx - px) - (ny - py)))


def may_match(x: str, y: str, least: Fraction, times: int = 1) -> Column:
    """Whether the sets of two postings of a key can be similar and this key is the first one that they share. With times:
    whether they differ in so many times the words, at the least, in which similar sets can."""
    a, b = least.numerator, least.denominator
    return _sizes(x, y, least) & ((a + b) * _differ(x, y) <= times * (b - a) * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, least: Fraction, broadcast_rows: int) -> DataFrame:
    """(sid, of_sid): of pairs those whose sets of words, made anew from the texts as 64-bit hashes,
    are similar; one for each sid. heads: (sid, place).

    The lines are looked up in the texts by broadcast if a count shows no more than `broadcast_rows`, else by a join.
    """
    a, b = least.numerator, least.denominator
    wanted = pairs.select("sid").union(pairs.select("of_sid")).distinct()
    wanted = materialise(heads.select("sid", *PLACE).join(wanted, "sid", "left_semi"), "wanted")
    few = wanted.count() <= broadcast_rows
    side = wanted.toDF("w_sid", "w_doc", "w_row", "w_line")
    own = wanted.select(F.col("doc_id").alias("d_doc"), F.col("row").alias("d_row")).distinct()
    side, own = (F.broadcast(side), F.broadcast(own)) if few else (side, own)
    rows = docs.join(own, F.col("doc_id").eqNullSafe(F.col("d_doc")) & (F.col("row") == F.col("d_row")), "left_semi")
    rows = rows.select("doc_id", "row", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))
    rows = rows.join(side, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("row") == F.col("w_row")) & (F.col("line_no") == F.col("w_line")))
    # rows that are equal in doc_id and text give a line more than once
    sets = materialise(rows.select(F.col("w_sid").alias("sid"), F.array_distinct(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))).alias("words")).dropDuplicates(["sid"]), "words")
    both = pairs.join(sets.toDF("sid", "words"), "sid").join(sets.toDF("of_sid", "of_words"), "of_sid")
    shared = F.size(F.array_intersect("words", "of_words"))
    found = both.filter((a + b) * shared >= a * (F.size("words") + F.size("of_words")))
    out = materialise(found.groupBy("sid").agg(F.min("of_sid").alias("of_sid")), "settled")
    forget(wanted)
    forget(sets)
    return out


def similar_sets(sets: DataFrame, heads: DataFrame, docs: DataFrame, least: Fraction = THRESHOLD, broadcast_rows: int = 500_000) -> DataFrame:
    """(sid, of_sid): sets that an earlier set is similar to, with one such set. The written table `sets` goes.

    Variants of one line would make pairs by the square of their number. So each posting first meets the earliest set of
    its key only. Sets that this doesn't settle then meet the sets that those earliest ones were found similar to, which
    for variants is the line that they all vary. In keys of more than LARGE sets, those near to the earliest one then meet the earliest of each of
    SLICES slices of these, and any one of each, and the nearest of them by their parities are tried. Only what is left meets all
    earlier sets that share a key. The postings are written in buckets by key, so that these joins move none of them.
    """

    def without(rows: DataFrame, settled: DataFrame) -> DataFrame:
        done = settled.select(F.col("sid").alias("s_sid"))
        done = F.broadcast(done) if settled.count() <= broadcast_rows else done
        return rows.join(done, F.col("sid") == F.col("s_sid"), "left_anti")

    spark = sets.sparkSession
    hot_class = max(HOT_CLASS, round(math.log2(docs.count() + 1)) - 8)
    of_key, parts = Window.partitionBy("key"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = F.min(F.struct("sid", "n", "pos", "p1", "p2")).over(of_key)
    near = (F.col("times") > LARGE) & may_match("x", "y", least, NEAR)
    earlier = F.col("x.sid") < F.col("y.sid")
    columns = ("key", "sid", "n", "pos", "p1", "p2")

    def met(turn: int) -> DataFrame:
        own = postings(sets, least, hot_class).filter(F.pmod("key", F.lit(TURNS)) == turn).repartition(parts, "key")
        own = own.withColumn("x", head).withColumn("times", F.count(F.lit(1)).over(of_key)).filter("times > 1").alias("y")
        return own.select(*(f"y.{c}" for c in columns), F.col("x.sid").alias("of_sid"), (earlier & may_match("x", "y", least)).alias("first"), near.alias("near"), F.expr("times > 2").alias("several"))

    crowded = bucketed([met(turn) for turn in range(TURNS)], "key", parts, "crowded")
    forget(sets)
    first = materialise(crowded.filter("first").select("sid", "of_sid").distinct(), "candidates")
    settled = verified(first, heads, docs, least, broadcast_rows)

    of_head = settled.select(F.col("sid").alias("h_sid"), F.col("of_sid").alias("z_sid"))
    of_head = F.broadcast(of_head) if settled.count() <= broadcast_rows else of_head
    y = without(crowded, settled).select("sid", F.col("of_sid").alias("h_sid"))
    through = y.join(of_head, "h_sid").select("sid", "z_sid").distinct()
    side = lambda name: heads.select(F.col("sid").alias(f"{name}_sid"), F.struct("n", "p1", "p2").alias(name))
    through = through.withColumnRenamed("sid", "y_sid").join(side("y"), "y_sid").join(side("z"), "z_sid").filter(_alike("z", "y", least))
    through = materialise(through.select(F.col("y_sid").alias("sid"), F.col("z_sid").alias("of_sid")), "candidates")
    more = verified(through, heads, docs, least, broadcast_rows)

    large = crowded.filter("near").select(*columns)
    own = F.struct("sid", "n", "pos", "p1", "p2")
    # of each slice first the earliest set, then any
    for seed, pick in enumerate((F.min(own), F.min_by(own, F.xxhash64("sid", F.lit("any"))))):
        settled = materialise(settled.union(more), "settled")
        some = large.groupBy(F.col("key").alias("x_key"), F.pmod(F.xxhash64("sid", F.lit(seed)), F.lit(SLICES)).alias("slice")).agg(pick.alias("x"))
        y = without(large, settled).select("key", own.alias("y"))
        tried = y.join(some.hint("merge"), F.col("key") == F.col("x_key")).filter(earlier & may_match("x", "y", least))
        tried = tried.groupBy(F.col("y.sid").alias("sid"), F.col("x.sid").alias("of_sid")).agg(F.min(_differ("x", "y")).alias("bits"))
        rank = F.row_number().over(Window.partitionBy("sid").orderBy("bits", "of_sid"))
        tried = materialise(tried.withColumn("rank", rank).filter(f"rank <= {TRIED}").select("sid", "of_sid"), "candidates")
        more = verified(tried, heads, docs, least, broadcast_rows)

    settled = materialise(settled.union(more), "settled")
    several = crowded.filter("several").select(*columns)
    rest = without(several, settled).alias("y").join(several.alias("x").hint("merge"), F.col("y.key") == F.col("x.key"))
    second = materialise(rest.filter(earlier & may_match("x", "y", least)).select(F.col("y.sid").alias("sid"), F.col("x.sid").alias("of_sid")).distinct(), "candidates")
    forget(crowded)
    last = verified(second, heads, docs, least, broadcast_rows)
    return settled.union(last)


def numbered(sets: DataFrame, places: DataFrame) -> DataFrame:
    """sets with a sid that rises with the place; places: theirs or more.

    Where each line has a doc_id that is its document's alone, and ids and lines fit in 62 bits, the two make the number. Else the
    sets are dealt by ranges of places and numbered in order.
    """
    line, doc = F.max("line_no"), F.col("doc_id")
    most = places.agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), line.alias("line"), F.coalesce(F.bool_or(doc.isNull() | (F.col("row") != 0)), F.lit(False)).alias("odd")).first()
    if most["line"] is not None and not most["odd"] and (most["hi"] - most["lo"] + 1) * (most["line"] + 1) < 1 << 62:
        return sets.withColumn("sid", (doc - F.lit(most["lo"])) * F.lit(most["line"] + 1).cast("long") + F.col("line_no"))
    return sets.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).withColumn("sid", F.monotonically_increasing_id())


def repeated_lines(docs: DataFrame, least: Fraction = THRESHOLD, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, row, line_no, of_doc, of_row, of_line): the lines of identified docs to remove, each with an earlier similar line.

    Lines are the parts of a text between \\n, counted from 0, words the runs of [^\\x20\\x09-\\x0D]; a line without words is
    never removed, so a null or empty text loses nothing. least: over 1/2. A null doc_id comes before all others. Rows
    that share a doc_id, or lack one, come in the order of a hash of their texts. Rows equal in both are one document whose
    equal places are ties: none goes for another. Words are compared by 57 bits of a hash to find pairs, and by 64 bits to
    confirm them.
    """
    if not Fraction(1, 2) < least <= 1:
        raise ValueError("the threshold must be over 1/2")
    lines = lines_of(docs)
    table, bits = rarity(docs)
    keyed = materialise(keyed_lines(lines, table, bits, least), "keyed")
    head = F.min(F.struct(*PLACE, "n", "p1", "p2", "prefix")).alias("x")
    sets = keyed.groupBy("h1", "h2").agg(head, F.count("*").alias("times")).select("h1", "h2", "times", "x.*")
    sets = materialise(numbered(sets, keyed), "sets")
    places = materialise(keyed.select(*PLACE, "h1", "h2"), "places")
    forget(keyed)
    heads = materialise(sets.select("sid", "h1", "h2", "times", *PLACE, "n", "p1", "p2"), "heads")
    similar = materialise(similar_sets(sets, heads, docs, least, broadcast_rows), "similar")
    of = heads.select(F.col("sid").alias("of_sid"), *(F.col(c).alias(o) for c, o in zip(PLACE, OF)))
    matched = similar.join(of, "of_sid").select("sid", *OF)
    own = heads.select("sid", "h1", "h2", "times", *(F.col(c).alias(f"s_{c}") for c in PLACE))
    marked = own.join(matched, "sid", "left").filter("times > 1 or of_line is not null")
    marked = marked.select("h1", "h2", *(f"s_{c}" for c in PLACE), *OF)
    found = places.join(marked, ["h1", "h2"])
    is_head = F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("row") == F.col("s_row")) & (F.col("line_no") == F.col("s_line_no"))
    gone = found.filter(~is_head | F.col("of_line").isNotNull())
    of = F.when(F.col("of_line").isNotNull(), F.struct(*OF)).otherwise(F.struct(*(F.col(f"s_{c}").alias(o) for c, o in zip(PLACE, OF))))
    gone = materialise(gone.select(*PLACE, of.alias("of")).select(*PLACE, "of.*").distinct(), "repeated")
    for done in (heads, places, similar):
        forget(done)
    return gone


def removals(docs: DataFrame, least: Fraction = THRESHOLD, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines, matched_docs, matched_lines): a row for each row of docs; arrays in line order, empty where nothing goes."""
    rows = identified(docs)
    gone = repeated_lines(rows, least, broadcast_rows).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("line_no", "of_doc", "of_line"))).alias("matches"))
    gone = gone.withColumnsRenamed({"doc_id": "g_doc", "row": "g_row"})
    counts = rows.select("doc_id", "row", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    none = F.expr("cast(array() as array<struct<line_no: int, of_doc: bigint, of_line: int>>)")
    out = counts.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("row") == F.col("g_row")), "left").withColumn("matches", F.coalesce("matches", none))
    return out.select("doc_id", "n_lines", F.size("matches").alias("n_removed"), F.transform("matches", lambda m: m["line_no"]).alias("removed_lines"), F.transform("matches", lambda m: m["of_doc"]).alias("matched_docs"), F.transform("matches", lambda m: m["of_line"]).alias("matched_lines"))


def kept_lines(text: Column, removed: Column) -> Column:
    """text without the lines numbered in removed, in time linear in both: the parts are cut once, outside the inner lambda."""
    parts = F.split(text, "\n")
    whole = F.array(F.struct(parts.alias("parts"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed).alias("stay")))
    return F.transform(whole, lambda s: F.array_join(F.transform(s["stay"], lambda i: F.get(s["parts"], i)), "\n"))[0]


def dedup(docs: DataFrame, least: Fraction = THRESHOLD, broadcast_rows: int = 500_000) -> DataFrame:
    """docs with the repeated lines taken out of text; every document stays, maybe with an empty text. n_chars, if there, follows the text."""
    doc, row, removed = (f"__{x}_{len(docs.columns)}{max(docs.columns, key=len)}" for x in ("doc", "row", "removed"))  # longer than any name of docs
    rows = identified(docs)
    gone = repeated_lines(rows, least, broadcast_rows).groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_list("line_no").alias(removed))
    gone = materialise(gone, "gone")
    # a row number other than 0 stands for the hash of the text
    at = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & ((F.col(row) == 0) | (F.col(row) == F.xxhash64(F.col("text").cast("string"))))
    lines_gone = gone.agg(F.coalesce(F.sum(F.size(removed)), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(gone) if lines_gone <= 4 * broadcast_rows and gone.count() <= broadcast_rows else gone, at, "left")
    kept = kept_lines(F.col("text"), F.col(removed))
    out = joined.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
