"""Raw roll-call rows to members, propositions, divisions and votes.

`raw` holds the text columns of the roll-call file and `row_no`, any orderable
column that gives the order of the rows in the file. "First" below always means
the smallest `row_no`.
"""

from pyspark.sql import DataFrame, functions as F

from hustings import vocab
from hustings.functions import votes as v
from hustings.operators.ids import dense_ids
from hustings.session import stage

RAW_COLUMNS = [
    "ID",
    "MemberName",
    "MemberPosition",
    "Date",
    "Reference",
    "Title",
    "PropositionTitle",
    "Vote",
]


def parse_rows(raw: DataFrame) -> DataFrame:
    """The columns that the tables are built from; every expression over the raw text is here.

    A missing cell is an empty text. Rows that are parsed already come back as they are, so a
    caller that needs several tables can parse and store them once.
    """
    if "canonical_name" in raw.columns:
        return raw
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in RAW_COLUMNS}
    return raw.select(
        text["ID"].try_cast("long").alias("division_id"),
        v.norm_name(text["MemberName"]).alias("canonical_name"),
        v.norm_position(text["MemberPosition"]).alias("position"),
        v.parse_date(text["Date"]).alias("date"),
        *[text[c].alias(c) for c in ("Reference", "Title", "PropositionTitle", "Vote")],
        "row_no",
    )


def build_members(raw: DataFrame, active_years: list[int] = vocab.ACTIVE_YEARS) -> DataFrame:
    """One row a member: first and last date, active flag, positions by frequency."""
    dated = parse_rows(raw).where("date IS NOT NULL").select("canonical_name", "position", "date", "row_no")
    positions = dated.groupBy("canonical_name", "position").agg(
        F.count("*").alias("count"),
        F.min("row_no").alias("first_row"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max(F.year("date").isin(active_years)).alias("active"),
    )
    # One entry a position, so the list is as short as the position vocabulary.
    history = F.array_sort(
        F.collect_list(F.struct((-F.col("count")).alias("rank"), "first_row", "position", "count"))
    )
    members = positions.groupBy("canonical_name").agg(
        F.min("first_date").alias("first_vote_date"),
        F.max("last_date").alias("last_vote_date"),
        F.max("active").alias("is_currently_active"),
        F.transform(history, lambda h: F.struct(h["position"], h["count"])).alias("position_history"),
    )
    numbered = dense_ids(members, ["canonical_name"], "member_id")
    return numbered.select(
        "member_id",
        "canonical_name",
        F.col("canonical_name").alias("display_name"),
        "first_vote_date",
        "last_vote_date",
        "is_currently_active",
        "position_history",
    )


def build_propositions(raw: DataFrame) -> DataFrame:
    """One row a base reference, numbered by year, number and first appearance."""
    # References repeat on every vote; each distinct text is parsed once.
    distinct = parse_rows(raw).groupBy("Reference").agg(
        F.min_by(F.struct(F.col("PropositionTitle").alias("title"), "row_no"), "row_no").alias("f")
    )
    parsed = distinct.select(
        v.parse_reference(F.col("Reference"))["base_ref"].alias("base_reference"), "f.title", "f.row_no"
    )
    first = parsed.groupBy("base_reference").agg(
        F.min_by("title", "row_no").alias("title"), F.min("row_no").alias("first_row")
    )
    number = v.reference_number(F.col("base_reference"))
    props = first.select(
        "base_reference",
        number["year"].alias("year"),
        number["number"].alias("number"),
        v.source_url(F.col("base_reference")).alias("source_url"),
        "title",
        "first_row",
    )
    numbered = dense_ids(props, ["year", "number", "first_row"], "proposition_id")
    return numbered.select(
        "proposition_id", "base_reference", "year", "number", "source_url", "title"
    )


def first_rows(raw: DataFrame) -> DataFrame:
    """The first row with a readable date of every division."""
    attributes = F.struct("row_no", "Title", "PropositionTitle", "Reference", "date")
    return (
        parse_rows(raw).where("date IS NOT NULL")
        .groupBy("division_id")
        .agg(F.min_by(attributes, "row_no").alias("f"))
        .select("division_id", "f.*")
    )


def member_votes(raw: DataFrame, members: DataFrame, firsts: DataFrame) -> DataFrame:
    """Readable votes: (division_id, member_id, vote, row_no), still with repeats.

    A row with an unreadable date counts once its division has been seen; only those
    rows are compared with the first row of the division.
    """
    named = parse_rows(raw).select(
        "division_id", "canonical_name", F.col("Vote").alias("vote"), "row_no", F.col("date").isNotNull().alias("dated")
    )
    late = (
        named.where("NOT dated")
        .join(firsts.select("division_id", F.col("row_no").alias("opened")), "division_id")
        .where("row_no > opened")
        .drop("opened")
    )
    kept = named.where("dated").unionByName(late)
    return kept.join(members.select("canonical_name", "member_id"), "canonical_name").select(
        "division_id", "member_id", "vote", "row_no"
    )


def is_active(vote):
    """Whether a vote was cast; a missing vote was not."""
    return F.coalesce(vote.isin(vocab.ACTIVE_VOTES), F.lit(False))


def dedupe_votes(rows: DataFrame, keys=("division_id", "member_id")) -> DataFrame:
    """One vote per key: the first row, unless a later one is active and it is not.

    `min_by` is pre-aggregated before the shuffle, and the shuffle key holds both
    the division and the member, so a large division spreads over all tasks.
    """
    idle = (~is_active(F.col("vote"))).alias("idle")
    chosen = rows.groupBy(*keys).agg(F.min_by("vote", F.struct(idle, "row_no")).alias("vote"))
    return chosen.withColumn("vote_category", v.vote_category(F.col("vote")))


def division_tallies(votes: DataFrame) -> DataFrame:
    vote = F.col("vote")
    return votes.groupBy("division_id").agg(
        F.count_if(vote == "Pour").alias("pour_count"),
        F.count_if(vote == "Contre").alias("contre_count"),
        F.count_if(vote == "Abstained").alias("abstain_count"),
        F.count_if(~is_active(vote)).alias("absent_count"),
        F.count("*").alias("total_eligible"),
    )


TALLIES = ["pour_count", "contre_count", "abstain_count", "absent_count", "total_eligible"]


def build_divisions(firsts: DataFrame, propositions: DataFrame, votes: DataFrame) -> DataFrame:
    """One row a division: attributes of its first readable row, and its tallies."""
    parsed = firsts.withColumn("ref", v.parse_reference(F.col("Reference")))
    attributes = parsed.select(
        "division_id",
        F.col("ref.base_ref").alias("base_reference"),
        F.col("Title").alias("title"),
        F.col("PropositionTitle").alias("proposition_title"),
        F.col("ref.clean_ref").alias("reference"),
        "date",
        v.stage(F.col("Title"), F.col("PropositionTitle")).alias("division_stage"),
        F.col("ref.amendment_number").alias("amendment_number"),
        F.col("ref.is_reissue").alias("is_reissue"),
    )
    return (
        attributes.join(
            propositions.select("base_reference", "proposition_id"), "base_reference", "left"
        )
        .join(division_tallies(votes), "division_id", "left")
        .fillna(0, TALLIES)
        .drop("base_reference")
    )


def build_all(raw: DataFrame, active_years: list[int] = vocab.ACTIVE_YEARS) -> dict[str, DataFrame]:
    """The four tables. The raw file is read and parsed once, into a stored narrow table."""
    raw = stage(parse_rows(raw), "parsed")
    firsts = stage(first_rows(raw), "firsts")
    members = build_members(raw, active_years)
    propositions = build_propositions(raw)
    votes = stage(dedupe_votes(member_votes(raw, members, firsts)), "votes")
    divisions = build_divisions(firsts, propositions, votes)
    return {
        "members": members,
        "propositions": propositions,
        "divisions": divisions,
        "votes": votes,
    }


def integrity(
    tables: dict[str, DataFrame],
    unique: dict[str, list[list[str]]],
    required: dict[str, list[str]],
    foreign: list[tuple[str, str, str, str]],
) -> DataFrame:
    """Violations as (rule, key, n): repeated keys, missing values, dangling references.

    `foreign` lists (table, column, parent table, parent column).
    """

    def rows(df: DataFrame, rule: str, columns: list[str]) -> DataFrame:
        # Grouped by the columns themselves; their text is for the reader.
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in columns]) if columns else F.lit("null")
        return df.groupBy(*columns).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), key.alias("key"), "n")

    found = []
    for table, keys in unique.items():
        for columns in keys:
            present = tables[table].dropna(subset=columns)
            found.append(rows(present, f"unique {table}({', '.join(columns)})", columns).where("n > 1"))
    for table, columns in required.items():
        for c in columns:
            missing = tables[table].where(F.col(c).isNull())
            found.append(rows(missing, f"not null {table}({c})", []).where("n > 0"))
    for table, column, parent, parent_column in foreign:
        child = tables[table].where(F.col(column).isNotNull())
        dangling = child.join(
            tables[parent].select(F.col(parent_column).alias("_p")).distinct(),
            F.col(column) == F.col("_p"),
            "left_anti",
        )
        found.append(rows(dangling, f"foreign {table}({column})", [column]))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
