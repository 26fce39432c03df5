"""Text expressions: whitespace, names, quotes, anchors, contacts, sections."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from hustings import vocab

# Whitespace as Unicode defines it, and the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"


def trim_spaces(text: Column) -> Column:
    left = F.regexp_replace(text, rf"(?U)^{SPACE}+", "")
    return F.regexp_replace(left, rf"(?U)(?<!{SPACE}){SPACE}+\z", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0))


def content_status(text: Column, low: int = vocab.LOW_CONTENT_WORDS) -> Column:
    n = word_count(text)
    return F.when(n == 0, "error").when(n < low, "low_content").otherwise("ok")


def unmarked(text: Column, form: str) -> Column:
    """Decompose the letters and drop the marks that combine with them.

    Spark has no Unicode normalisation, so this one step is an Arrow function;
    plain ASCII text, the usual case, skips it as null.
    """

    @F.pandas_udf("string")
    def decompose(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            parts = unicodedata.normalize(form, value)
            if form == "NFD":
                return "".join(c for c in parts if not "\u0300" <= c <= "\u036f")
            return "".join(c for c in parts if not unicodedata.combining(c))

        return values.map(one, na_action="ignore")

    return F.coalesce(decompose(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def canonical_name(name: Column) -> Column:
    plain = F.regexp_replace(unmarked(name, "NFKD"), rf"(?U)[^A-Za-z0-9\s\x1c-\x1f]", " ")
    return F.lower(collapse_spaces(plain))


def initial_key(canonical: Column) -> Column:
    """First letter and last word of a canonical name; null for a single word."""
    parts = F.split(canonical, " ")
    return F.when(
        F.size(parts) >= 2,
        F.concat(F.substring(canonical, 1, 1), F.lit(" "), F.element_at(parts, -1)),
    )


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(unmarked(name, "NFD")), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def first_name(full_name: Column) -> Column:
    return F.substring_index(trim_spaces(full_name), " ", 1)


def norm_quote(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), rf"(?U){SPACE}+", " ")
    return F.trim(F.translate(spaced, "‘’“”–—", "''''--"))


def quote_matches(source: Column, quote: Column) -> Column:
    """Whether a non-empty quote occurs in its source, both normalised."""
    found = F.contains(norm_quote(source), norm_quote(quote))
    return F.coalesce((quote != "") & found, F.lit(False))


def between_anchors(text: Column, starts: list[str], ends: list[str]) -> Column:
    """The text after the first start anchor found (in list order) and before the next end."""
    low = F.lower(text)

    begin = F.coalesce(
        *[
            F.when(F.instr(low, a.lower()) > 0, F.instr(low, a.lower()) + len(a))
            for a in starts
        ]
    )
    stop = F.coalesce(
        *[F.nullif(F.position(F.lit(a.lower()), low, begin), F.lit(0)) for a in ends],
        F.length(text) + 1,
    )
    return F.when(begin.isNull(), "").otherwise(
        trim_spaces(F.substr(text, begin, stop - begin))
    )


def contacts(text: Column) -> Column:
    """struct(email, phone, party): the first of each, null when there is none."""

    def first(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, "(?U)" + pattern, group), F.lit(""))

    party = trim_spaces(first(vocab.PARTY_PATTERN, 1))
    return F.struct(
        first(vocab.EMAIL_PATTERN, 0).alias("email"),
        trim_spaces(first(vocab.PHONE_PATTERN, 0)).alias("phone"),
        F.when(F.lower(party).isin(vocab.NO_PARTY_WORDS), "Independent")
        .otherwise(party)
        .alias("party"),
    )


def excerpt(text: Column, size: int, longer_than: int = 50) -> Column:
    return F.when(F.length(text) > longer_than, F.substring(text, 1, size))


def effective_text(better: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(better, F.lit("")), original)


def summary_fallback(summary: Column, extended: Column) -> Column:
    """The summary, else the first line of the long form that is no heading."""
    lines = F.filter(
        F.split(extended, "\n"), lambda s: (trim_spaces(s) != "") & ~F.startswith(s, F.lit("**"))
    )
    return F.coalesce(
        F.nullif(summary, F.lit("")), trim_spaces(F.try_element_at(lines, F.lit(1))), summary
    )


def sections(text: Column) -> Column:
    """array<struct(title, body)>: lines `**Title** rest` open a section.

    A document is one row, so its lines stay in the row and nothing is shuffled.
    """
    heading = r"^\*\*(.+?)\*\*\s*(.*)"
    lines = F.filter(F.split(text, "\n"), lambda s: trim_spaces(s) != "")
    marked = F.transform(
        lines, lambda s: F.when(s.rlike("(?U)" + heading), F.concat(F.lit("\x01"), s)).otherwise(s)
    )
    chunks = F.filter(F.split(F.array_join(marked, "\n"), "\n?\x01"), lambda c: c != "")

    def section(chunk: Column) -> Column:
        body = F.split(chunk, "\n")
        head = F.element_at(body, 1)
        titled = head.rlike("(?U)" + heading)
        first = F.when(titled, F.regexp_extract(head, "(?U)" + heading, 2)).otherwise(head)
        rest = F.slice(body, F.lit(2), F.size(body))
        return F.struct(
            F.when(titled, F.regexp_extract(head, "(?U)" + heading, 1)).otherwise("").alias("title"),
            F.array_join(
                F.concat(F.when(titled & (first == ""), F.array().cast("array<string>")).otherwise(F.array(first)), rest), " "
            ).alias("body"),
        )

    return F.transform(chunks, section)
