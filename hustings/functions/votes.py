"""Roll-call expressions: names, references, stages, dates, vote values, shares."""

from functools import reduce

from pyspark.sql import Column, functions as F

from hustings import vocab
from hustings.functions.text import collapse_spaces, trim_spaces


def vote_category(vote: Column) -> Column:
    return (
        F.when(vote.isin(vocab.ACTIVE_VOTES), "active_vote")
        .when(vote.isin(vocab.EXCUSED_ABSENCES), "excused_absence")
        .when(vote.isin(vocab.UNEXCUSED_ABSENCES), "unexcused_absence")
        .otherwise("unknown")
    )


def norm_name(name: Column) -> Column:
    return collapse_spaces(name)


def norm_position(position: Column) -> Column:
    pairs = [F.lit(x) for pair in vocab.LEGACY_POSITIONS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), position), position)


def parse_reference(reference: Column) -> Column:
    """struct(base_ref, amendment_number, is_reissue, clean_ref)."""
    clean = F.when(
        F.contains(reference, F.lit("|")), trim_spaces(F.substring_index(reference, "|", -1))
    ).otherwise(reference)
    base = F.regexp_extract(clean, vocab.REFERENCE_PATTERN, 0)
    matched = base != ""
    rest = F.substr(clean, F.length(base) + 1)
    number = F.regexp_extract(rest, vocab.AMENDMENT_PATTERN, 1)
    return F.struct(
        F.when(matched, base).otherwise(clean).alias("base_ref"),
        F.when(
            matched & F.contains(rest, F.lit("(Amd)")),
            F.when(number == "", 1).otherwise(number.try_cast("int")),
        ).alias("amendment_number"),
        (matched & rest.rlike(vocab.REISSUE_PATTERN)).alias("is_reissue"),
        clean.alias("clean_ref"),
    )


def reference_number(base_ref: Column) -> Column:
    """(number, year) of a base reference; zeros when it does not parse."""
    matched = base_ref.rlike(vocab.REFERENCE_PATTERN)
    number = F.regexp_extract(base_ref, r"^P\.(\d+)/", 1).try_cast("int")
    year = F.regexp_extract(base_ref, r"^P\.\d+/(\d{4})", 1).try_cast("int")
    return F.struct(
        F.when(matched, number).otherwise(0).alias("number"),
        F.when(matched, year).otherwise(0).alias("year"),
    )


def source_url(base_ref: Column, template: str = vocab.PROPOSITION_URL) -> Column:
    number = F.regexp_extract(base_ref, r"^P\.(\d+)/", 1)
    year = F.regexp_extract(base_ref, r"^P\.\d+/(\d{4})", 1)
    url = F.replace(
        F.replace(F.lit(template), F.lit("{number}"), number), F.lit("{year}"), year
    )
    return F.when(base_ref.rlike(vocab.REFERENCE_PATTERN), url)


def stage(title: Column, proposition_title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    p = F.lower(F.coalesce(proposition_title, F.lit("")))
    both = F.concat_ws(" ", t, p)

    def has(text: Column, word: str) -> Column:
        return F.contains(text, F.lit(word))

    procedural = reduce(lambda a, b: a | b, [has(both, w) for w in vocab.PROCEDURAL_WORDS])
    return (
        F.when(has(t, "principles") | has(F.substring_index(p, ")", -1), "principles"), "principles")
        .when(has(both, "third reading"), "third_reading")
        .when(t.rlike("(?U)" + vocab.ARTICLES_PATTERN), "articles")
        .when(has(t, "amendment") | has(t, "amd"), "amendment")
        .when(has(t, "paragraph"), "paragraph")
        .when(has(t, "regulation"), "regulations")
        .when(procedural, "procedural")
        .otherwise("other")
    )


def parse_date(text: Column) -> Column:
    """Day first, padded or not; null when the text is no such date."""
    return F.try_to_timestamp(text, F.lit("d/M/yyyy H:m:s"))


def vote_value(vote: Column) -> Column:
    """+1, -1 or 0 for an active vote, null for an absence."""
    return F.when(vote == "Pour", 1).when(vote == "Contre", -1).when(vote == "Abstained", 0)


def closeness(pour: Column, contre: Column) -> Column:
    return F.least(pour, contre).cast("double") / F.nullif(pour + contre, F.lit(0))


def split_distance(pour: Column, contre: Column) -> Column:
    return F.abs(pour.cast("double") / F.nullif(pour + contre, F.lit(0)) - 0.5)


def passed(pour: Column, contre: Column) -> Column:
    """A tie fails."""
    return pour > contre


def majority(pour: Column, contre: Column) -> Column:
    """The side of the majority; a tie counts as Pour."""
    return F.when(pour >= contre, 1).otherwise(-1)


def main_position(history: Column) -> Column:
    return F.coalesce(
        F.try_element_at(history, F.lit(1))["position"], F.lit(vocab.DEFAULT_POSITION)
    )


def rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part.cast("double") / total).otherwise(F.lit(0.0))


def pour_share(pour: Column, contre: Column) -> Column:
    total = pour + contre
    return F.when(total > 0, pour.cast("double") / total * 100).otherwise(F.lit(50.0))


def presentation_group(vote: Column) -> Column:
    """The heading a vote is listed under; texts outside the vocabulary have none."""
    return (
        F.when(vote.isin(vocab.ACTIVE_VOTES), vote)
        .when(vote.isin(vocab.UNEXCUSED_ABSENCES), "Not Present")
        .when(vote.isin(vocab.EXCUSED_ABSENCES), "Other")
    )
