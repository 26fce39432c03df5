"""How members vote relative to each other and to the majority."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hustings import vocab
from hustings.functions import votes as v
from hustings.operators.blocks import count_of, self_products
from hustings.session import sized


def eligible_divisions(
    divisions: DataFrame,
    since: str | None = vocab.TERM_START,
    stages: Sequence[str] | None = tuple(vocab.ALIGNMENT_STAGES),
    topics: Sequence[str] | None = None,
) -> DataFrame:
    chosen = divisions
    if stages:
        chosen = chosen.where(F.col("division_stage").isin(list(stages)))
    if since:
        chosen = chosen.where(F.col("date") >= F.lit(since).cast(chosen.schema["date"].dataType))
    if topics:
        chosen = chosen.where(F.col("topic_primary").isin(list(topics)))
    return chosen


def vote_values(
    votes: DataFrame,
    divisions: DataFrame,
    members: DataFrame,
    since: str | None = vocab.TERM_START,
    stages: Sequence[str] | None = tuple(vocab.ALIGNMENT_STAGES),
    topics: Sequence[str] | None = None,
    active_only: bool = True,
) -> DataFrame:
    """The vote matrix in long form: (member_id, division_id, v); an absence has no row."""
    chosen = eligible_divisions(divisions, since, stages, topics).select("division_id")
    people = members.where("is_currently_active") if active_only else members
    return (
        votes.where(F.col("vote").isin(vocab.ACTIVE_VOTES))
        .select("member_id", "division_id", v.vote_value(F.col("vote")).alias("v"))
        .join(chosen, "division_id", "left_semi")
        .join(people.select("member_id"), "member_id", "left_semi")
    )


def _products(
    values: DataFrame, members: DataFrame, divisions: DataFrame, every_pair: bool
) -> DataFrame:
    return self_products(
        values.select(F.col("member_id").alias("id"), F.col("division_id").alias("key"), "v"),
        members.select(F.col("member_id").alias("id")),
        count_of(divisions),
        every_pair=every_pair,
    )


def alignment(
    values: DataFrame,
    members: DataFrame,
    divisions: DataFrame,
    empty: str = "null",
    strangers: bool = False,
) -> DataFrame:
    """Agreement of every pair m1 <= m2: (m1, m2, agreed, shared, pct).

    `members` and `divisions` are the rows and columns of the matrix. Pairs without a shared
    division are left out, which keeps the result sparse in a wide body; with `strangers` they
    are rows as well, and their `pct` is null, or 0 with `empty='zero'`.
    """
    pairs = _products(values, members, divisions, strangers)
    agreed = ((F.col("shared") + F.col("dot")) / 2).cast("long")
    pct = F.when(F.col("shared") > 0, agreed / F.col("shared"))
    if empty == "zero":
        pct = F.coalesce(pct, F.lit(0.0))
    return pairs.select(
        F.col("a").alias("m1"),
        F.col("b").alias("m2"),
        agreed.alias("agreed"),
        "shared",
        pct.alias("pct"),
    )


def aligned_pairs(
    pairs: DataFrame, members: DataFrame, min_shared: int = 50, n: int = 15
) -> DataFrame:
    """The n most and n least aligned pairs with enough shared divisions."""
    names = members.select("member_id", "canonical_name")
    named = (
        pairs.where((F.col("m1") != F.col("m2")) & (F.col("shared") >= min_shared))
        .join(names.select(F.col("member_id").alias("m1"), F.col("canonical_name").alias("n1")), "m1")
        .join(names.select(F.col("member_id").alias("m2"), F.col("canonical_name").alias("n2")), "m2")
        .select(
            F.least("n1", "n2").alias("name1"),
            F.greatest("n1", "n2").alias("name2"),
            "pct",
            "shared",
        )
    )
    most = named.orderBy(F.desc("pct"), "name1", "name2").limit(n)
    least = named.orderBy("pct", "name1", "name2").limit(n)
    return most.select(F.lit("most").alias("side"), "*").unionByName(
        least.select(F.lit("least").alias("side"), "*")
    )


def cosine(values: DataFrame, members: DataFrame, divisions: DataFrame, strangers: bool = False) -> DataFrame:
    """Cosine similarity of pairs m1 <= m2, absences and abstentions being 0.

    Pairs without a shared division have the similarity 0 and are rows with `strangers` only.
    """
    pairs = _products(values, members, divisions, strangers)
    # Two rows a pair look a norm up: it is broadcast unless there are too many, as pairs are many more.
    norms = sized(values.where("v <> 0").groupBy("member_id").agg(F.count("*").alias("n")), "norms")
    return (
        pairs.join(norms.select(F.col("member_id").alias("a"), F.col("n").alias("na")), "a", "left")
        .join(norms.select(F.col("member_id").alias("b"), F.col("n").alias("nb")), "b", "left")
        .select(
            F.col("a").alias("m1"),
            F.col("b").alias("m2"),
            F.coalesce(F.col("dot") / F.sqrt(F.col("na") * F.col("nb")), F.lit(0.0)).alias("similarity"),
        )
    )


def independence(values: DataFrame, divisions: DataFrame, members: DataFrame) -> DataFrame:
    """How often each member votes against the majority of a division."""
    side = divisions.select(
        "division_id", v.majority(F.col("pour_count"), F.col("contre_count")).alias("majority")
    )
    counted = (
        values.where("v <> 0")
        .join(side, "division_id")
        .groupBy("member_id")
        .agg(
            F.count_if(F.col("v") != F.col("majority")).alias("dissent_count"),
            F.count("*").alias("total_active_votes"),
        )
    )
    return (
        members.select("member_id", "canonical_name")
        .join(counted, "member_id", "left")
        .fillna(0, ["dissent_count", "total_active_votes"])
        .withColumn("dissent_rate", v.rate(F.col("dissent_count"), F.col("total_active_votes")))
    )


def participation(
    votes: DataFrame, members: DataFrame, divisions: DataFrame, since: str | None = vocab.TERM_START
) -> DataFrame:
    """Attendance of active members since a date."""
    chosen = eligible_divisions(divisions, since, None).select("division_id")
    category = F.col("vote_category")
    active = members.where("is_currently_active").select("member_id", "canonical_name")
    counted = (
        votes.join(chosen, "division_id", "left_semi")
        .join(active.select("member_id"), "member_id", "left_semi")
        .groupBy("member_id")
        .agg(
            F.count("*").alias("total_divisions"),
            F.count_if(category == "active_vote").alias("active_votes"),
            F.count_if(category == "excused_absence").alias("excused_absences"),
            F.count_if(category == "unexcused_absence").alias("unexcused_absences"),
            F.count_if(F.col("vote") == "Abstained").alias("abstentions"),
        )
    )
    return (
        counted.join(active, "member_id")
        .withColumn("participation_rate", v.rate(F.col("active_votes"), F.col("total_divisions")))
        .withColumn("unexcused_rate", v.rate(F.col("unexcused_absences"), F.col("total_divisions")))
        .drop("member_id")
        .orderBy("canonical_name")
    )
