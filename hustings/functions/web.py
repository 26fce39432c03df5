"""Expressions over stored HTML: entities, tags, articles, metadata, cards, links."""

import html as html_lib

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from hustings import vocab
from hustings.functions.text import (
    SPACE,
    between_anchors,
    contacts,
    trim_spaces,
    word_count,
)

# Entities resolved in the JVM; `&amp;` comes last so that nothing is decoded twice.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": " ",
    "&middot;": "·",
    "&copy;": "©",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&hellip;": "…",
    "&amp;": "&",
}


@F.pandas_udf(T.StringType())
def _unescape_any(values: pd.Series) -> pd.Series:
    return values.map(html_lib.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """HTML entities to characters.

    Only texts that hold an entity outside the common set go through Arrow.
    """
    known = "|".join(e[1:] for e in COMMON_ENTITIES)
    rare = text.rlike(rf"&(?!(?:{known}))[A-Za-z#]")
    common = text
    for entity, char in COMMON_ENTITIES.items():
        common = F.replace(common, F.lit(entity), F.lit(char))
    return F.coalesce(_unescape_any(F.when(rare, text)), common)


def _lines_for_blocks(text: Column) -> Column:
    broken = F.regexp_replace(text, rf"(?U)<br{SPACE}*/?>", "\n")
    return F.regexp_replace(broken, vocab.BLOCK_ENDS, "\n")


def strip_tags(html: Column, scripts: bool = False) -> Column:
    """Text of a page; `scripts=True` also drops script and style elements."""
    text = unescape(html)
    if scripts:
        for element in vocab.SCRIPT_ELEMENTS:
            text = F.regexp_replace(text, element, " ")
    text = F.regexp_replace(_lines_for_blocks(text), "<[^>]+>", " ")
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, rf"(?U)\n{SPACE}*\n+", "\n\n")
    return trim_spaces(text)


def article_text(html: Column) -> Column:
    """Text inside the first article element, without style-sheet leftovers."""
    text = unescape(F.regexp_extract(html, vocab.ARTICLE_PATTERN, 1))
    text = F.regexp_replace(_lines_for_blocks(text), "<[^>]+>", " ")
    for leftover in vocab.STYLE_LEFTOVERS:
        text = F.regexp_replace(text, "(?U)" + leftover.replace(r"\s", SPACE), "")
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, rf"(?U)\n{SPACE}*\n", "\n\n")
    return trim_spaces(text)


def page_meta(html: Column) -> Column:
    """struct(lodged_by, published_date, debate_date)."""

    def labelled(label: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(rf"(?U){label}{SPACE}*:{SPACE}*([^<\n]+)"), F.lit(1))
        return trim_spaces(F.try_element_at(found, F.lit(1)))

    return F.struct(*[labelled(label).alias(name) for name, label in vocab.PAGE_LABELS.items()])


def main_block(html: Column) -> Column:
    """Text of the structural manifesto block of a profile page, '' when it has none."""
    inner = F.regexp_extract(html, vocab.MAIN_BLOCK_PATTERN, 1)
    for embed in vocab.EMBED_PATTERNS:
        inner = F.regexp_replace(inner, embed, "")
    return strip_tags(inner)


def main_content(
    html: Column,
    starts: list[str] = vocab.CONVICTION_ANCHORS,
    ends: list[str] = vocab.PROPOSER_ANCHORS,
    enough: int = 30,
) -> Column:
    """The structural block, or the anchored text when that is short and the other longer."""
    block = main_block(html)
    anchored = between_anchors(strip_tags(html), starts, ends)
    return F.when(
        (word_count(block) < enough) & (word_count(anchored) > word_count(block)), anchored
    ).otherwise(block)


def profile(html: Column) -> Column:
    """struct(manifesto_text, email, phone, party) of a profile page."""
    found = contacts(strip_tags(html))
    return F.struct(
        main_content(html).alias("manifesto_text"),
        found["email"].alias("email"),
        found["phone"].alias("phone"),
        found["party"].alias("party"),
    )


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def title_case(text: Column) -> Column:
    """Every run of letters starts with a capital."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def figures(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(vocab.CARD_PATTERN), F.lit(1))


def card(figure: Column, site: str) -> Column:
    """One profile card: slug, URL, name, photo, role, constituency, party."""
    path = F.rtrim(
        F.regexp_replace(
            _first(figure, vocab.CARD_LINK_PATTERN),
            "^https?://[^/]*",
            "",
        ),
        F.lit("/"),
    )
    path = F.concat(path, F.lit("/"))
    key = _first(path, vocab.CARD_KEY_PATTERN)
    heading = F.regexp_extract(figure, vocab.CARD_HEADING_PATTERN, 1)
    name = F.nullif(
        trim_spaces(unescape(F.regexp_extract(heading, vocab.CARD_NAME_PATTERN, 1))), F.lit("")
    )
    listed = F.regexp_extract_all(figure, F.lit(vocab.CARD_ITEM_PATTERN), F.lit(1))
    items = F.transform(F.split(strip_tags(F.array_join(listed, "\x02")), "\x02"), trim_spaces)
    items = F.filter(items, lambda t: t != "")
    standing = "(?iU)" + vocab.STANDING_PATTERN.replace(r"\s", SPACE)
    roles = F.filter(items, lambda t: t.rlike(standing))
    labels = F.filter(items, lambda t: ~t.rlike(standing))
    role = title_case(
        F.rtrim(
            trim_spaces(F.regexp_extract(F.try_element_at(roles, F.lit(-1)), standing, 1)), F.lit(".")
        )
    )
    party = F.try_element_at(labels, F.lit(1))
    area = F.try_element_at(labels, F.lit(2))
    return F.struct(
        key.alias("slug"),
        F.concat(F.lit(site), path).alias("profile_url"),
        F.coalesce(name, title_case(F.replace(key, F.lit("-"), F.lit(" ")))).alias("full_name"),
        _first(figure, vocab.CARD_PHOTO_PATTERN).alias("photo_url"),
        F.when(F.lower(role).rlike("^conn[eé]table"), "Connétable").otherwise(role).alias("role"),
        trim_spaces(F.regexp_replace(area, rf"(?U)\bSt\.{SPACE}*", "St ")).alias("constituency"),
        F.when(~F.lower(party).isin(vocab.NO_PARTY_LABELS), party).alias("party"),
    )


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.substring_index(authority, "@", -1), r":\d*$", ""))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts without `www.`, or one a subdomain of the other."""

    def bare(host: Column) -> Column:
        low = F.lower(F.coalesce(host, F.lit("")))
        return F.regexp_replace(F.regexp_replace(low, r"^\.+", ""), r"^www\.", "")

    x, y = bare(a), bare(b)
    dot = F.lit(".")
    nested = F.endswith(x, F.concat(dot, y)) | F.endswith(y, F.concat(dot, x))
    return (x != "") & (y != "") & ((x == y) | nested)


def _without_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    closed = F.when(last.isin(".", "..") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/")))
    resolved = F.coalesce(closed, joined)
    return F.when(path.rlike(r"/\.\.?(/|$)"), resolved).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """An href against the URL of its page, without fragment."""
    link = F.substring_index(href, "#", 1)
    page = F.substring_index(base, "#", 1)
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(page, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    own_path = F.substring_index(link, "?", 1)
    query = F.substr(link, F.length(own_path) + 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, _without_dots(own_path), query))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .when(link == "", page)
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own_path)), query))
    )
