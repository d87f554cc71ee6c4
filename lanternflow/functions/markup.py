"""HTML and Markdown as Column expressions: main content, breadcrumbs, links, sections, extracts and chunks.

Texts are folded piece by piece with aggregate, so all of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternflow.functions.text import SPACES, strip

#: Names of character references, with the semicolon, and what they stand for.
_NAMED = "\x02".join(f"{name}\x01{value}" for name, value in sorted(html5.items()) if name.endswith(";"))


def decode_entities(c: Column) -> Column:
    """Character references as what they stand for, decoded once: decimal and hexadecimal ones, and names that end with a semicolon."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)&#[0-9]{1,12};|&#[xX][0-9a-fA-F]{1,9};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), F.lit(0))
    body = lambda x, n: F.substring(x, F.lit(n), F.length(x) - n)
    code = lambda x: F.when(F.substring(x, 3, 1).isin("x", "X"), F.conv(body(x, 4), 16, 10)).otherwise(body(x, 3)).cast("long")
    # Zero, half surrogates and what is beyond Unicode become U+FFFD.
    valid = lambda n: F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), n).otherwise(F.lit(0xFFFD))
    number = lambda x: F.decode(F.unhex(F.lpad(F.hex(valid(code(x))), 8, "0")), "UTF-32")
    named = F.str_to_map(F.lit(_NAMED), F.lit("\x02"), F.lit("\x01"))
    one = lambda x: F.when(x.startswith("&#"), number(x)).when(x.startswith("&") & (F.length(x) > 1), F.coalesce(F.try_element_at(named, F.substring(x, F.lit(2), F.length(x))), x)).otherwise(x)
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def breadcrumb_context(html: Column, tag: str = "nav", split_text: bool = False) -> Column:
    """Context: A > B and a blank line, from the list items of the first such element; else, if asked for, from its text cut at >."""
    block = container(html, tag)
    plain = lambda x: strip(decode_entities(F.regexp_replace(x, r"<[^>]+>", "")))
    items = F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"(?s)<li(?: [^>]*)?>(.*?)</li>"), F.lit(1)), plain), lambda x: x != "")
    if split_text:
        words = F.filter(F.transform(F.split(plain(block), ">"), strip), lambda x: x != "")
        items = F.when(F.size(items) > 0, items).otherwise(words)
    return F.when(F.size(items) > 0, F.concat(F.lit("Context: "), F.array_join(items, " > "), F.lit("\n\n"))).otherwise(F.lit(""))


#: A tag, whose quoted values may hold >.
_TAG_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>"
#: Comments, texts that hold no tags, and the tags of links.
_LINKS = rf"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*>|\z)|<a(?=[\s/]){_TAG_REST}"
#: An attribute: its name, and its value in double, single or no quotes.
_ATTRIBUTE = r"(?s)([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"


def attribute(tag: Column, name: str) -> Column:
    """The decoded value of a tag's first attribute of this name, in any case and quoting; null without one."""
    rest = F.regexp_replace(tag, r"\A<[^\s/>]+", "")
    part = lambda k: F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), F.lit(k))
    all_parts = F.arrays_zip(part(1).alias("name"), part(2).alias("a"), part(3).alias("b"), part(4).alias("c"))
    own = F.filter(all_parts, lambda x: F.lower(x["name"]) == name)
    return _let(F.get(own, F.lit(0)), lambda x: decode_entities(F.concat(x["a"], x["b"], x["c"])))


def hrefs(html: Column) -> Column:
    """The targets of a page's links, in any case and quoting; none from comments, scripts and other texts that hold no tags."""
    tags = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_LINKS), F.lit(0)), lambda t: F.lower(F.substring(t, 1, 2)) == "<a")
    return F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda x: x.isNotNull())


def container(html: Column, tag: str = "article") -> Column:
    """What the first element of this name holds, up to its own end tag or the end of the page; null where there is none, or nothing in it."""
    rest = F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{tag}(?:\s[^>]*)?>(.*)\z", 1)
    # Each piece but the first begins with a tag of this name; pieces are taken until as many are closed as were opened.
    pieces = F.split(rest, rf"(?i)(?=</?{tag}(?:[\s/][^>]*)?>)")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    deeper = lambda x: F.when(F.lower(F.substring(x, 1, len(tag) + 2)) == f"</{tag}", -1).when(F.lower(F.substring(x, 1, len(tag) + 1)) == f"<{tag}", 1).otherwise(0)
    step = lambda s, x: F.when(s["depth"] <= 0, s).otherwise(_let(s["depth"] + deeper(x), lambda d: F.struct(d.alias("depth"), F.when(d > 0, s["n"] + 1).otherwise(s["n"]).alias("n"))))
    return _let(pieces, lambda p: F.nullif(F.array_join(F.slice(p, F.lit(1), F.aggregate(p, start, step)["n"]), ""), F.lit("")))


#: Comments, and elements whose text holds no tags.
_NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)\b[^>]*>.*?(?:</\1\s*>|\z)"


def is_tag(selector: Column) -> Column:
    """Whether a selector is the name of a tag alone, of those whose end tag is never left out."""
    return selector.rlike(r"^[a-z][a-z0-9]*$") & ~selector.isin(*"li p dt dd tr td th option area base br col embed hr img input link meta source track wbr".split())


def _matches(html: Column, *pattern: Column | str) -> Column:
    parts = (F.lit(x) if isinstance(x, str) else x for x in pattern)
    return F.size(F.regexp_extract_all(html, F.concat(*parts), F.lit(0)))


def plain_elements(html: Column, tag: Column) -> Column:
    """Whether all that looks like tags of this name is one: no comment, script or attribute holds any, none closes itself or leaves an
    attribute open, and there are as many end tags as begin tags. Then own_part finds what a parser would."""
    shown = F.regexp_replace(html, _NO_TAGS, "")
    begins = _matches(html, "(?i)<", tag, r"(?=[\s/>])")
    strict = _matches(shown, "(?i)<", tag, r"(?:\s+[\w:-]+(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=/]+))?)*\s*>")
    quoted = F.rlike(html, F.concat(F.lit(r"(?i)=\s*(?:\"[^\"]*<"), tag, F.lit(r"|'[^']*<"), tag, F.lit(")")))
    return (begins == strict) & (_matches(html, "(?i)</", tag, r"\s*>") == begins) & (_matches(html, "(?i)</", tag, r"(?=[\s/>])") == begins) & ~quoted


def own_part(html: Column, tag: Column) -> Column:
    """What the first element of this name, itself a column, holds up to its own end tag; null without such an element."""
    pieces = F.split(html, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"(?:\s[^>]*)?>)")))
    opens = lambda x: F.rlike(x, F.concat(F.lit("(?i)^<"), tag, F.lit(r"[\s>]")))
    closes = lambda x: F.rlike(x, F.concat(F.lit("(?i)^</"), tag, F.lit(r"[\s>]")))
    # begin and end: the pieces, from 1, that begin with the first begin tag and with its end tag.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(opens(x), 1).when(closes(x) & (s["begin"] > 0), -1).otherwise(0)
        return _let(
            F.struct((s["at"] + 1).alias("at"), depth.alias("depth")),
            lambda n: F.struct(
                n["at"].alias("at"),
                n["depth"].alias("depth"),
                F.when((s["begin"] == 0) & (n["depth"] > 0), n["at"]).otherwise(s["begin"]).alias("begin"),
                F.when((s["end"] == 0) & (s["begin"] > 0) & (n["depth"] == 0), n["at"]).otherwise(s["end"]).alias("end"),
            ),
        )

    def part(p: Column) -> Column:
        held = lambda s: F.array_join(F.slice(p, s["begin"], s["end"] - s["begin"]), "")
        return _let(F.aggregate(p, start, step), lambda s: F.when((s["begin"] > 0) & (s["end"] > 0), F.regexp_replace(held(s), r"\A<[^>]*>", "")))

    return _let(pieces, part)


def shown_texts(html: Column) -> Column:
    """The texts between tags, decoded and stripped; none is empty."""
    texts = F.transform(F.split(F.regexp_replace(html, _HIDDEN, ""), "<[^>]*>"), lambda x: strip(decode_entities(x)))
    return F.filter(texts, lambda x: x != "")


def crumb_items(block: Column, from_text: Column) -> Column:
    """The items of a breadcrumb; without items, if asked for, its text cut at >."""
    items = F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>"), F.lit(1)), lambda x: F.array_join(shown_texts(x), "")), lambda x: x != "")
    words = F.filter(F.transform(F.split(F.array_join(shown_texts(block), ""), ">"), strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.size(items) > 0, items).when(from_text, words), none)


def plain_items(block: Column) -> Column:
    """Whether the items of a breadcrumb are closed each and hold no others."""
    begins, ends = _matches(block, r"(?i)<li(?=[\s/>])"), _matches(block, r"(?i)</li\s*>")
    return (begins == ends) & (_matches(block, r"(?is)<li(?:\s[^>\"']*+(?:\"[^\"<>]*\"[^>\"']*+)*)?>(?:(?!<li[\s/>]).)*?</li\s*>") == begins) & ~block.rlike(r"(?i)<!--|<script|<style")


#: Rewriting steps; attribute values may hold > in quotes.
_IN_TAG = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
_VALUE = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_STEPS = [
    *((rf"(?i)<h{n}(?:\s[^>]*)?>", "\n\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i)</h[1-6]>|</?(?:p|div|section|blockquote|table)(?:\s[^>]*)?>|</?pre>", "\n\n"),
    (r"(?i)<br\s*/?>|</tr>", "\n"),
    (r"(?i)<hr\s*/?>", "\n\n* * *\n\n"),
    (r"(?i)<li(?:\s[^>]*)?>", "\n  * "),
    (r"(?i)</t[dh]>\s*<t[dh](?:\s[^>]*)?>", " | "),
    (rf"(?is)<img(?=[^>]*?\ssrc\s*=\s*{_VALUE})(?=[^>]*?\salt\s*=\s*{_VALUE}){_IN_TAG}", "![$4$5$6]($1$2$3)"),
    (rf"(?is)<img(?=[^>]*?\ssrc\s*=\s*{_VALUE}){_IN_TAG}", "![]($1$2$3)"),
    (rf"(?is)<a\b(?=[^>]*?\shref\s*=\s*{_VALUE}){_IN_TAG}(.*?)</a\s*>", "[$4]($1$2$3)"),
    (r"(?i)</?(?:b|strong)>", "**"),
    (r"(?i)</?(?:i|em)>", "_"),
    (r"(?i)</?(?:code|tt)>", "`"),
    (rf"</?[A-Za-z]{_IN_TAG}|<[!?/][^>]*>", ""),
]
#: Stands for a line end in preformatted text while others are taken away; of the private use area.
_LINE = "\ue000"


def _within(html: Column, tag: str, change: Callable[[Column], Column]) -> Column:
    """html with change() made to each element of this name, up to its first end tag. Without such an element nothing is cut."""
    parts = F.split(html, rf"(?i)(?=<{tag}[\s>])|(?<=</{tag}>)")
    mine = lambda x: F.lower(F.substring(x, 1, len(tag) + 1)) == f"<{tag}"
    return F.when(html.rlike(rf"(?i)<{tag}[\s>]"), F.array_join(F.transform(parts, lambda x: F.when(mine(x), change(x)).otherwise(x)), "")).otherwise(html)


def to_markdown(html: Column) -> Column:
    """Markdown of an HTML fragment: headings, paragraphs, line breaks, list items (those of ol numbered), links and images in any quoting, rows of
    tables with | between cells, preformatted, bold and italic text and code; comments, scripts and styles are left out."""
    html = F.regexp_replace(html, _HIDDEN, "")
    html = _within(html, "pre", lambda x: F.replace(F.regexp_replace(x, r"(?i)<pre(?:\s[^>]*)?>", "<pre>    "), F.lit("\n"), F.lit(_LINE + "    ")))
    html = F.regexp_replace(html, r"\s*\n\s*", " ")
    items = lambda x: F.array_join(F.transform(F.split(x, r"(?i)<li(?:\s[^>]*)?>"), lambda y, n: F.when(n == 0, y).otherwise(F.concat(F.lit("\n  "), n.cast("string"), F.lit(". "), y))), "")
    html = _within(html, "ol", items)
    for pattern, value in _STEPS:
        html = F.regexp_replace(html, pattern, value)
    html = F.replace(F.replace(decode_entities(html), F.lit("\u00a0"), F.lit(" ")), F.lit(_LINE), F.lit("\n"))
    for pattern, value in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        html = F.regexp_replace(html, pattern, value)
    return html


def split_headings(markdown: Column) -> Column:
    """Pieces of a text, cut before headings of level 1 to 3; none is blank."""
    return F.filter(F.transform(F.split(markdown, r"(?md)(?=^#{1,3}\s)"), strip), lambda x: x != "")


def pack_sections(pieces: Column, min_len: int = 100, max_len: int = 1000) -> Column:
    """Pieces joined to a short one before them; longer ones than max_len packed anew by paragraph."""
    texts = F.array().cast("array<string>")

    def packed(piece: Column) -> Column:
        empty = F.struct(texts.alias("done"), F.lit("").alias("held"))

        def step(s: Column, para: Column) -> Column:
            full = (F.length(s["held"]) + F.length(para) > max_len) & (s["held"] != "")
            joined = F.when(s["held"] != "", F.concat(s["held"], F.lit("\n\n"), para)).otherwise(para)
            return F.struct(F.when(full, F.array_append(s["done"], strip(s["held"]))).otherwise(s["done"]).alias("done"), F.when(full, para).otherwise(joined).alias("held"))

        return F.aggregate(F.split(piece, "\n\n"), empty, step, lambda s: F.when(s["held"] != "", F.array_append(s["done"], strip(s["held"]))).otherwise(s["done"]))

    def add(out: Column, piece: Column) -> Column:
        n = F.size(out)
        last = F.element_at(out, -1)
        short = (n > 0) & (F.length(F.try_element_at(out, F.lit(-1))) < min_len)
        grown = F.array_append(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.concat(last, F.lit("\n\n"), piece))
        return F.when(short, grown).when(F.length(piece) > max_len, F.concat(out, packed(piece))).otherwise(F.array_append(out, piece))

    return F.aggregate(pieces, texts, add)


#: Characters of a piece of a long text that is cut at once.
PIECE_CHARS = 4096


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _cut(text: Column, limit: int, least: float, place: Callable[[Column], Column]) -> Column:
    """Parts of a text: while more than limit is left, what place(window) says is cut off; parts are stripped, and none is empty.

    place() sees the first limit characters of what is left, and cuts off at least least * limit of them. So only
    a short rest is carried from one piece of a long text to the next: the work grows with the text, not with its square.
    """
    none = F.array().cast("array<string>")
    push = lambda out, x: F.when(x != "", F.array_append(out, x)).otherwise(out)

    def off(s: Column) -> Column:
        """The state after one cut."""
        rest = s["rest"]
        tail = lambda at: F.ltrim(F.substring(rest, at + 1, F.length(rest)), F.lit(SPACES))
        return _let(place(F.substring(rest, 1, limit)), lambda at: F.struct(push(s["done"], strip(F.substring(rest, F.lit(1), at))).alias("done"), tail(at).alias("rest")))

    def cuts(rest: Column) -> Column:
        """What is cut off a rest while it is longer than limit."""
        rounds = F.sequence(F.lit(1), (F.ceil(F.length(rest) / (least * limit)) + 1).cast("int"))
        start = F.struct(none.alias("done"), rest.alias("rest"))
        return F.aggregate(rounds, start, lambda s, _: F.when(F.length(s["rest"]) > limit, off(s)).otherwise(s))

    # White space at the end counts for the first cut alone; after it, what is left is stripped.
    first = F.struct(none.alias("done"), text.alias("rest"))
    first = F.when(F.length(text) > limit, _let(first, off)).otherwise(first)

    def whole(s: Column) -> Column:
        pieces = F.regexp_extract_all(F.rtrim(s["rest"], F.lit(SPACES)), F.lit(f"(?s).{{1,{max(PIECE_CHARS, limit)}}}"), F.lit(0))
        begin = F.struct(F.array(s["done"]).alias("done"), F.lit("").alias("rest"))
        step = lambda t, piece: _let(cuts(F.ltrim(F.concat(t["rest"], piece), F.lit(SPACES))), lambda c: F.struct(F.array_append(t["done"], c["done"]).alias("done"), c["rest"].alias("rest")))
        return F.aggregate(pieces, begin, step, lambda t: push(F.flatten(t["done"]), t["rest"]))

    # A text that was not cut is left as it is.
    return F.when(F.length(text) > limit, _let(first, whole)).otherwise(push(none, text))


def _last_blank_line(window: Column) -> Column:
    """Characters before the last blank line of a window, negative without one."""
    return F.length(window) - F.length(F.substring_index(window, "\n\n", -1)) - 2


def extract_windows(text: Column, prefix: Column, limit: int = 100_000) -> Column:
    """Windows of at most limit characters, cut after the last blank line if that is past half; the prefix stands before each."""

    def place(window: Column) -> Column:
        blank = _last_blank_line(window)
        return _let(blank, lambda n: F.when(n > limit * 0.5, n + 2).otherwise(F.lit(limit))).cast("int")

    return F.transform(_cut(F.coalesce(text, F.lit("")), limit, 0.5, place), lambda x: F.concat(F.coalesce(prefix, F.lit("")), x))


def chunk_extract(text: Column, limit: int = 1000) -> Column:
    """Chunks of about limit characters: cut at the last heading if that is past 0.3, else, if there is no heading at all, after the last blank line if that is past half.

    A text that begins with Context: and has a blank line keeps what is before that as a prefix of each chunk.
    """
    text = F.coalesce(text, F.lit(""))
    end = F.instr(text, "\n\n") - 1
    has = text.startswith("Context:") & (end > 0)
    prefix = F.when(has, F.substring(text, F.lit(1), end + 2)).otherwise(F.lit(""))
    body = F.when(has, strip(F.substring(text, end + 3, F.length(text)))).otherwise(text)
    skipped = max(0, limit - 1000)

    def place(window: Column) -> Column:
        seen = F.substring(window, skipped + 1, limit) if skipped else window
        # What stands before the last heading, in front of a mark; empty without a heading.
        found = F.when(seen.contains("#"), F.regexp_extract(F.concat(F.lit("."), seen), r"(?sd)\A(\..*(?<=^\.|\n))#{1,6}\s", 1)).otherwise(F.lit(""))
        blank = _last_blank_line(window)
        with_heading = lambda n: F.when(n + skipped > limit * 0.3, n + skipped).otherwise(F.lit(limit))
        without = F.when(blank > limit * 0.5, blank + 2).otherwise(F.lit(limit))
        return _let(F.length(found), lambda n: F.when(n > 0, with_heading(n - 1)).otherwise(without)).cast("int")

    chunks = F.transform(_cut(body, limit, 0.3, place), lambda x: F.concat(prefix, x))
    return F.filter(chunks, lambda x: strip(x) != "")


