"""Scalar column functions. They all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\x0B\f\r ]"


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity (Spark's round goes away from zero)."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where there is no whole."""
    return F.when(whole != 0, part / whole)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def norm_key(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed: equal for texts that differ in case and signs only."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def capitalise(text: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def joined(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def cap(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def cut_at_word(text: Column, most: int, mark: str = "…") -> Column:
    """Longer texts are cut to `most` characters, back to the last white space, and marked."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", ""), F.lit(mark))).otherwise(text)


def condense(text: Column, head: int = 9000, tail: int = 5000, slack: int = 500, mark: str = "\n\n[… middle of the opinion omitted …]\n\n") -> Column:
    """Head and tail of a long text, cut at words; others as they are. The cut is at the head's very end, also where that is a line's."""
    front = F.regexp_replace(F.substring(text, 1, head), r"\s+\S*\z", "")
    back = F.regexp_replace(F.right(text, F.lit(tail)), r"^\S*\s+", "")
    return F.when(F.length(text) > head + tail + slack, F.concat(front, F.lit(mark), back)).otherwise(text)


def word_count(text: Column) -> Column:
    """Runs of non-white characters that hold an ASCII letter or digit."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike("[A-Za-z0-9]")))


#: Entities in the order in which they are replaced; &amp; comes last, so that it opens no other.
ENTITIES = [
    ("&nbsp;", " "),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&sect;", "§"),
    ("&lsquo;", "'"),
    ("&rsquo;", "'"),
    ("&ldquo;", '"'),
    ("&rdquo;", '"'),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
]


def decode_entities(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))

    def numbered(text: Column, pattern: str, base: int) -> Column:
        """Replace each numeric entity: the parts between matches, and the matches' characters."""
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        between = F.split(text, pattern)
        signs = F.transform(found, lambda d: F.decode(F.unhex(F.lpad(F.conv(d, base, 16), 8, "0")), "UTF-32"))
        return F.when(F.size(found) > 0, F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), F.concat(signs, F.array(F.lit(""))).alias("s")), lambda x: F.array(x["b"], x["s"]))), "")).otherwise(text)

    text = numbered(text, "(?i)&#x([0-9a-f]{1,5});", 16)
    text = numbered(text, "&#([0-9]{1,6});", 10)
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def html_to_text(html: Column) -> Column:
    """Scripts and styles dropped, block ends as line ends, other tags dropped, entities decoded once, white space tidied."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"(?i)</(p|div|h[0-9]|li|blockquote|br)>|<br\s*/?>", "\n")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", ""))
    text = F.regexp_replace(text, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def snippet(html: Column, most: int = 700) -> Column:
    """Tags dropped, entities decoded, white space collapsed, cut at a word; null is empty."""
    text = decode_entities(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", ""))
    return cut_at_word(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", ""), most)


def plain_tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def first_long(fields: list[tuple[str, bool]], least: int = 200) -> Column:
    """The first field whose trimmed length is over `least`, tidied if plain, flattened if markup; else empty. fields: (column, plain)."""
    out = F.lit("")
    for name, plain in reversed(fields):
        own = F.regexp_replace(F.col(name), r"^\s+|\s+$", "")
        out = F.when(F.length(own) > least, plain_tidy(own) if plain else html_to_text(own)).otherwise(out)
    return out


def client_address(forwarded: Column, real: Column) -> Column:
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(first != "", first), F.when(real != "", real), F.lit("local"))


def display_url(path: Column, number: Column, site: str) -> Column:
    """An absolute link stays, a path gets the site, else the number makes a link, else the site's own."""
    return F.when(F.coalesce(path, F.lit("")) != "", F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(site), path))).when(F.coalesce(number, F.lit(0)) != 0, F.concat(F.lit(site + "/opinion/"), number.cast("string"), F.lit("/"))).otherwise(F.lit(site))


def percent_encoded(text: Column) -> Column:
    """URL encoding with %20 for a space, and !'()* left as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def jurisdiction_label(name: Column) -> Column:
    return F.when(name == "Federal", "the federal courts").otherwise(name)


def is_bot(agent: Column) -> Column:
    #: Marks of automatic clients.
    marks = "bot|crawl|spider|slurp|facebookexternalhit|preview|lighthouse|headless|curl|wget"
    return agent.isNull() | (agent == "") | agent.rlike(f"(?i){marks}")


def is_browser_id(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f-]{36}$"), F.lit(False))


def valid_page(text: Column, most: int = 20) -> Column:
    """The whole number from 1 to `most` that the text holds, else null."""
    n = text.try_cast("int")
    return F.when(text.rlike("^[0-9]+$") & n.between(1, most), n)


#: Patterns of error messages in order, with the code of the first that matches.
ERROR_CODES = [
    ("password|encrypt", "password_protected"),
    ("invalid|corrupt|not a", "invalid_file"),
    ("memory|too large|size", "too_large"),
    ("network|fetch|timeout", "network"),
]


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The value of the first rule, in order, whose pattern occurs in the text, whatever the case."""
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), value).otherwise(out)
    return out


def query_from_keywords(words: Column, broad: bool = False) -> Column:
    """Boolean query: the first two of three or more words are alternatives that must match with one of the rest; fewer words, or broad, are alternatives all."""
    bare = F.transform(words, lambda w: F.trim(w))
    quoted = F.filter(F.transform(bare, lambda w: F.when(w.rlike(r"\s"), F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit("")), F.lit('"'))).otherwise(w)), lambda w: w != "")
    any_of = F.array_join(quoted, " OR ")
    if broad:
        return any_of
    strict = F.concat(F.lit("("), F.element_at(quoted, 1), F.lit(" OR "), F.element_at(quoted, 2), F.lit(") AND ("), F.array_join(F.slice(quoted, 3, 1 << 20), " OR "), F.lit(")"))
    return F.when(F.size(quoted) < 3, any_of).otherwise(strict)


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999."""
    #: Roman numerals by descending value.
    signs = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    parts, rest = [], n
    for value, sign in signs:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*parts)


def letters(n: Column) -> Column:
    """a to z, then aa, bb and so on."""
    return F.repeat(F.char(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))
