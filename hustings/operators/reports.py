"""Reports over members, divisions, propositions and candidates."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from hustings import vocab
from hustings.functions import votes as v
from hustings.functions.text import slug
from hustings.operators.alignment import eligible_divisions
from hustings.operators.scoring import in_area
from hustings.session import stage as staged


def _pour():
    return F.col("pour_count")


def _contre():
    return F.col("contre_count")


def current(candidates: DataFrame, year: int | None = vocab.ELECTION_YEAR) -> DataFrame:
    """Candidates that have not opted out; every public report starts here."""
    kept = candidates.where("opted_out_at IS NULL")
    return kept.where(F.col("election_year") == year) if year else kept


# --- members -------------------------------------------------------------------


def member_list(members: DataFrame, votes: DataFrame) -> DataFrame:
    """All members with vote counts, active ones first.

    `total_divisions` counts joined rows and is 1 for a member without votes, as
    published; `total_votes` is the true number.
    """
    counts = votes.groupBy("member_id").agg(
        F.count_if(F.col("vote_category") == "active_vote").alias("active_votes"),
        F.count("*").alias("total_votes"),
        F.count_if(F.col("vote") == "Pour").alias("pour_count"),
        F.count_if(F.col("vote") == "Contre").alias("contre_count"),
    )
    return (
        members.join(counts, "member_id", "left")
        .fillna(0, ["active_votes", "total_votes", "pour_count", "contre_count"])
        .select(
            "member_id",
            "canonical_name",
            "display_name",
            "is_currently_active",
            v.main_position(F.col("position_history")).alias("main_position"),
            F.to_date("first_vote_date").alias("first_date"),
            F.to_date("last_vote_date").alias("last_date"),
            "active_votes",
            F.greatest("total_votes", F.lit(1)).alias("total_divisions"),
            "total_votes",
            "pour_count",
            "contre_count",
        )
        .orderBy(F.desc("is_currently_active"), "canonical_name")
    )


def member_totals(votes: DataFrame) -> DataFrame:
    category, vote = F.col("vote_category"), F.col("vote")
    totals = votes.groupBy("member_id").agg(
        F.count("*").alias("total_divisions"),
        F.count_if(category == "active_vote").alias("active_votes"),
        F.count_if(vote == "Pour").alias("pour"),
        F.count_if(vote == "Contre").alias("contre"),
        F.count_if(vote == "Abstained").alias("abstained"),
        F.count_if(category == "unexcused_absence").alias("unexcused"),
        F.count_if(category == "excused_absence").alias("excused"),
    )
    return totals.withColumn(
        "participation_pct", v.rate(F.col("active_votes"), F.col("total_divisions")) * 100
    )


def member_topics(votes: DataFrame, divisions: DataFrame, props: DataFrame) -> DataFrame:
    """Pour and Contre of each member by topic."""
    topics = props.where("topic_primary IS NOT NULL").select("proposition_id", "topic_primary")
    of_division = divisions.select("division_id", "proposition_id").join(topics, "proposition_id")
    counts = (
        votes.where(F.col("vote").isin("Pour", "Contre"))
        .join(of_division.select("division_id", "topic_primary"), "division_id")
        .groupBy("member_id", "topic_primary")
        .agg(
            F.count("*").alias("count"),
            F.count_if(F.col("vote") == "Pour").alias("pour"),
            F.count_if(F.col("vote") == "Contre").alias("contre"),
        )
    )
    return counts.withColumn("pour_pct", v.pour_share(F.col("pour"), F.col("contre"))).orderBy(
        "member_id", F.desc("count"), "topic_primary"
    )


def member_recent_votes(
    votes: DataFrame,
    divisions: DataFrame,
    props: DataFrame,
    n: int = 20,
    stages: Sequence[str] = tuple(vocab.ALIGNMENT_STAGES),
) -> DataFrame:
    """The latest n active votes of each member on key stages."""
    chosen = (
        eligible_divisions(divisions, None, stages)
        .join(props.select("proposition_id", "topic_primary"), "proposition_id")
        .select(
            "division_id",
            "proposition_title",
            "date",
            "pour_count",
            "contre_count",
            "division_stage",
            "topic_primary",
        )
    )
    latest = Window.partitionBy("member_id").orderBy(F.desc("date"), "division_id")
    return (
        votes.where(F.col("vote").isin(vocab.ACTIVE_VOTES))
        .select("member_id", "division_id", "vote")
        .join(chosen, "division_id")
        .withColumn("place", F.row_number().over(latest))
        .where(F.col("place") <= n)
    )


# --- divisions -----------------------------------------------------------------


def _with_props(divisions: DataFrame, props: DataFrame) -> DataFrame:
    return divisions.join(
        props.select(
            "proposition_id",
            "base_reference",
            "source_url",
            "topic_primary",
            "plain_language_summary",
        ),
        "proposition_id",
    )


def recent_votes(divisions: DataFrame, props: DataFrame, n: int = 6) -> DataFrame:
    return (
        _with_props(eligible_divisions(divisions, None, vocab.ALIGNMENT_STAGES), props)
        .orderBy(F.desc("date"), "division_id")
        .limit(n)
    )


def vote_list(
    divisions: DataFrame,
    props: DataFrame,
    topic: str | None = None,
    stage: str | None = None,
    page: int = 1,
    per_page: int = 30,
) -> DataFrame:
    """One page of divisions, latest first, with the number of all matches."""
    matches = _with_props(divisions, props)
    if topic:
        matches = matches.where(F.col("topic_primary") == topic)
    if stage:
        matches = matches.where(F.col("division_stage") == stage)
    matches = staged(matches, "matches")  # counted and paged
    total = matches.select(F.count("*")).scalar()
    return (
        matches.orderBy(F.desc("date"), "division_id")
        .offset((max(1, page) - 1) * per_page)
        .limit(per_page)
        .withColumn("passed", v.passed(_pour(), _contre()))
        .withColumn("total", total)
        .withColumn("pages", F.ceil(F.col("total") / per_page))
    )


def division_rollcall(votes: DataFrame, members: DataFrame, division_ids=None) -> DataFrame:
    """Who voted how, with the heading each vote is listed under."""
    chosen = votes if division_ids is None else votes.where(F.col("division_id").isin(list(division_ids)))
    return chosen.join(
        members.select("member_id", "canonical_name", "display_name", "position_history"), "member_id"
    ).select(
        "division_id",
        "member_id",
        "canonical_name",
        v.main_position(F.col("position_history")).alias("position"),
        "vote",
        "vote_category",
        v.presentation_group(F.col("vote")).alias("heading"),
    )


def _divisive(divisions: DataFrame, since: str | None, min_votes: int) -> DataFrame:
    return (
        eligible_divisions(divisions, since, vocab.DIVISIVE_STAGES)
        .where(_pour() + _contre() >= min_votes)
        .withColumn("closeness", v.closeness(_pour(), _contre()))
    )


def topic_divisiveness(
    divisions: DataFrame,
    props: DataFrame,
    since: str | None = vocab.TERM_START,
    min_votes: int = 10,
    min_divisions: int = 3,
) -> DataFrame:
    topics = props.where("topic_primary IS NOT NULL").select("proposition_id", "topic_primary")
    return (
        _divisive(divisions, since, min_votes)
        .join(topics, "proposition_id")
        .groupBy("topic_primary")
        .agg(F.count("*").alias("vote_count"), F.avg("closeness").alias("avg_closeness"))
        .where(F.col("vote_count") >= min_divisions)
        .orderBy(F.desc("avg_closeness"), "topic_primary")
    )


def closest_votes(
    divisions: DataFrame,
    props: DataFrame,
    since: str | None = vocab.TERM_START,
    min_votes: int = 20,
    n: int = 25,
) -> DataFrame:
    """The closest division of each proposition, and of those the n closest."""
    best = (
        _divisive(divisions, since, min_votes)
        .groupBy("proposition_id")
        .agg(
            F.min_by(
                F.struct(
                    "division_id",
                    "proposition_title",
                    "date",
                    "pour_count",
                    "contre_count",
                    "division_stage",
                    "closeness",
                ),
                F.struct((-F.col("closeness")).alias("c"), "division_id"),
            ).alias("d")
        )
        .select("proposition_id", "d.*")
    )
    return _with_props(best, props).orderBy(F.desc("closeness"), "division_id").limit(n)


def polarisation(divisions: DataFrame, min_votes: int = 10) -> DataFrame:
    return (
        _divisive(divisions, None, min_votes)
        .groupBy(F.year("date").alias("year"))
        .agg(F.count("*").alias("vote_count"), F.avg("closeness").alias("avg_closeness"))
        .orderBy("year")
    )


def topic_counts(divisions: DataFrame, props: DataFrame, since: str | None = vocab.TERM_START) -> DataFrame:
    topics = props.where("topic_primary IS NOT NULL").select("proposition_id", "topic_primary")
    return (
        eligible_divisions(divisions, since)
        .join(topics, "proposition_id")
        .groupBy("topic_primary")
        .agg(F.count_distinct("division_id").alias("vote_count"))
        .orderBy("topic_primary")
    )


def topic_list(props: DataFrame) -> DataFrame:
    """Topics in use, as offered by the division filter."""
    return props.where("topic_primary IS NOT NULL").select("topic_primary").distinct().orderBy("topic_primary")


def breakdowns(**tables: tuple[DataFrame, str]) -> DataFrame:
    """Row counts by label for several tables: (kind, label, n).

    For example `breakdowns(stage=(divisions, "division_stage"))`; rows without a label
    count as UNCLASSIFIED.
    """
    parts = []
    for kind, (df, column) in tables.items():
        parts.append(
            df.groupBy(F.coalesce(F.col(column), F.lit("UNCLASSIFIED")).alias("label"))
            .agg(F.count("*").alias("n"))
            .select(F.lit(kind).alias("kind"), "label", "n")
        )
    return reduce(DataFrame.unionByName, parts)


def added_counts(*counts: DataFrame) -> DataFrame:
    """Totals by label over several (label, n) tables."""
    return reduce(DataFrame.unionByName, counts).groupBy("label").agg(F.sum("n").alias("n"))


# --- candidates ----------------------------------------------------------------


def headline(
    members: DataFrame, props: DataFrame, divisions: DataFrame, candidates: DataFrame, questions: DataFrame
) -> DataFrame:
    """One row of site-wide counts; each table is counted once."""
    people = current(candidates).agg(
        F.count("*").alias("total_candidates"),
        F.count("incumbent_member_id").alias("incumbents"),
        F.count_distinct("constituency").alias("constituency_count"),
        F.count("classified_at").alias("classified"),
        F.count_if(F.col("scrape_status") == "low_content").alias("low_content"),
        F.max("scraped_at").alias("last_scrape"),
    )

    def total(df: DataFrame):
        return df.select(F.count("*")).scalar()

    return people.select(
        total(members.where("is_currently_active")).alias("active_members"),
        total(props).alias("total_propositions"),
        total(divisions).alias("total_divisions"),
        total(questions).alias("questions"),
        "*",
    )


def top_topics(topics: DataFrame, n: int = 4) -> DataFrame:
    """Each candidate's n most salient topics, unknown salience first, as an array."""
    order = Window.partitionBy("candidate_id").orderBy(F.desc_nulls_first("salience"), "topic")
    ranked = topics.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    listed = F.array_sort(F.collect_list(F.struct("place", "topic")))
    return ranked.groupBy("candidate_id").agg(F.transform(listed, lambda t: t["topic"]).alias("topics"))


def candidate_list(
    candidates: DataFrame,
    topics: DataFrame,
    area: str | None = None,
    role: str | None = None,
    party: str | None = None,
    topic: str | None = None,
    q: str | None = None,
    areas: dict[str, list[str]] | None = None,
    year: int | None = vocab.ELECTION_YEAR,
) -> DataFrame:
    """Candidates passing every given filter, by name, with their main topics."""
    conditions = []
    if area:
        conditions.append(in_area(F.lit(area), areas))
    if role:
        conditions.append(F.col("role") == role)
    if party:
        conditions.append(F.col("party") == party)
    if q:
        pattern = q.replace("\\", "\\\\")
        conditions.append(F.col("full_name").ilike(f"%{pattern}%"))
    found = current(candidates, year)
    if conditions:
        found = found.where(reduce(lambda a, b: a & b, conditions))
    if topic:
        found = found.join(topics.where(F.col("topic") == topic), "candidate_id", "left_semi")
    return found.join(top_topics(topics), "candidate_id", "left").orderBy("full_name", "candidate_id")


def filter_options(
    candidates: DataFrame, topics: DataFrame, year: int | None = vocab.ELECTION_YEAR
) -> DataFrame:
    """Values offered by the candidate filters: (kind, value)."""
    shown = current(candidates, year)
    kinds = {"constituency": shown, "role": shown, "party": shown, "topic": topics}
    parts = [
        df.where(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), F.col(c).alias("value")).distinct()
        for c, df in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("kind", "value")


def candidate_profile(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates with the member they are, if any."""
    return candidates.where("opted_out_at IS NULL").join(
        members.select(
            F.col("member_id").alias("incumbent_member_id"),
            F.col("canonical_name").alias("incumbent_canonical_name"),
            F.col("display_name").alias("incumbent_display_name"),
        ),
        "incumbent_member_id",
        "left",
    )


def stance_grid(stances: DataFrame, questions: DataFrame) -> DataFrame:
    """Every stance with its question and the correction applied."""
    return stances.join(
        questions.select("question_id", "topic", "statement", "sort_order"), "question_id"
    ).withColumn("effective_stance", F.coalesce("corrected_stance", "stance"))


def topic_examples(questions: DataFrame, n: int = 2) -> DataFrame:
    order = Window.partitionBy("topic").orderBy("sort_order", "question_id")
    return (
        questions.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .select("topic", "place", "statement")
    )


# --- routes --------------------------------------------------------------------


def route_listing(
    members: DataFrame,
    candidates: DataFrame,
    static: DataFrame,
    site: str,
    year: int | None = vocab.ELECTION_YEAR,
) -> DataFrame:
    """Static routes, candidate pages and member pages: (url, priority, change_frequency)."""

    def routes(df: DataFrame, path, priority: float, frequency: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(site), path).alias("url"),
            F.lit(priority).alias("priority"),
            F.lit(frequency).alias("change_frequency"),
        )

    people = routes(current(candidates, year), F.concat(F.lit("/candidates/"), "slug"), 0.9, "daily")
    seats = routes(
        members, F.concat(F.lit("/members/"), slug(F.col("canonical_name"))), 0.7, "weekly"
    )
    fixed = static.select(
        F.concat(F.lit(site), "path").alias("url"), "priority", "change_frequency"
    )
    return fixed.unionByName(people).unionByName(seats)
