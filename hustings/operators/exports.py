"""Review lists and message tables."""

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from hustings import vocab
from hustings.functions.text import first_name, trim_spaces


def review_export(
    candidates: DataFrame, host: str, year: int | None = vocab.ELECTION_YEAR
) -> DataFrame:
    """One line a candidate with a review link and defaults for what is missing.

    It covers candidates who opted out as well.
    """
    chosen = candidates.where(F.col("election_year") == year) if year else candidates
    found = F.coalesce(F.col("enhanced_manifesto_status") == "found", F.lit(False))

    def text(column: str, default: str = "") -> Column:
        return F.coalesce(F.nullif(column, F.lit("")), F.lit(default)).alias(column)

    token = F.nullif("correction_token", F.lit(""))
    return chosen.select(
        "candidate_id",
        "full_name",
        text("role"),
        text("constituency"),
        text("party"),
        text("email"),
        F.coalesce(F.concat(F.lit(f"{host}/candidates/correction/"), token), F.lit("")).alias("preview_url"),
        text("correction_state", "pending"),
        F.coalesce("manifesto_word_count", F.lit(0)).alias("manifesto_word_count"),
        F.when(F.col("classified_at").isNotNull(), "yes").otherwise("no").alias("classified"),
        F.when(found, "yes").otherwise("no").alias("enhanced_manifesto_found"),
        F.when(found, F.coalesce("enhanced_manifesto_source_url", F.lit(""))).otherwise("").alias(
            "enhanced_manifesto_url"
        ),
        F.when(found, F.coalesce("enhanced_manifesto_source_label", F.lit(""))).otherwise("").alias(
            "enhanced_manifesto_source"
        ),
        F.when(found, F.coalesce("enhanced_manifesto_word_count", F.lit(0))).otherwise(0).alias(
            "enhanced_manifesto_word_count"
        ),
    ).orderBy("full_name", "candidate_id")


def fill_template(template: str, fields: Mapping[str, Column]) -> Column:
    """A template with {named} fields; text in a field is never read as a field."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(fields[name].cast("string"))
    return F.concat(*pieces)


def message_table(
    review: DataFrame, templates: Mapping[str, str], subject: str, plain: str = "plain"
) -> DataFrame:
    """A message for every candidate with an address.

    `templates` holds one text for candidates with an enhanced manifesto (`enhanced`)
    and one for the others (named by `plain`).
    """
    name = first_name(F.col("full_name"))
    fields = {
        "first_name": name,
        "preview_url": F.col("preview_url"),
        "manifesto_wc": F.col("manifesto_word_count"),
        "enhanced_url": F.col("enhanced_manifesto_url"),
        "enhanced_wc": F.col("enhanced_manifesto_word_count"),
    }
    enhanced = F.col("enhanced_manifesto_found") == "yes"
    return (
        review.withColumn("email", trim_spaces(F.col("email")))
        .where("email <> ''")
        .select(
            "email",
            name.alias("first_name"),
            "full_name",
            "role",
            "constituency",
            F.when(enhanced, "enhanced").otherwise(plain).alias("variant"),
            F.lit(subject).alias("subject"),
            F.when(enhanced, fill_template(templates["enhanced"], fields))
            .otherwise(fill_template(templates[plain], fields))
            .alias("body"),
        )
    )
