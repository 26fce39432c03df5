"""Queries over the roll call: ingest, reports, alignment, spectrum."""

from pyspark.sql import functions as F

from hustings.functions import votes as v
from hustings.operators import alignment as al
from hustings.operators import ingest, reports, scoring, spectrum
from hustings.plans.fixtures import PART_TYPES, SINCE, YEARS, Views
from hustings.plans.registry import query
from hustings.session import new_path
from hustings.sources import files

DATE = "try_strptime(\"Date\", '%d/%m/%Y %H:%M:%S')"
KEY_STAGES = "('principles', 'third_reading')"
WIDE_STAGES = "('principles', 'third_reading', 'amendment')"


# --- sources and scalar expressions over the raw file ------------------------------


@query(
    "scan_votes",
    """SELECT ID, MemberName, MemberPosition, "Date", Reference, Title, PropositionTitle, Vote, count(*) AS n
       FROM rollcall GROUP BY ALL""",
    "rollcall",
)
def scan_votes(t: Views):
    path = new_path(t.spark, "rollcall-csv")
    files.write_csv(t.rollcall.select(ingest.RAW_COLUMNS), path)
    return files.scan_votes(t.spark, path).groupBy(ingest.RAW_COLUMNS).agg(F.count("*").alias("n"))


@query(
    "vote_category",
    """SELECT vote, CASE WHEN vote IN ('Pour', 'Contre', 'Abstained') THEN 'active_vote'
         WHEN vote = 'Ill' THEN 'excused_absence'
         WHEN vote IN ('Not present for vote', 'En défaut') THEN 'unexcused_absence'
         ELSE 'unknown' END AS vote_category, count(*) AS n FROM lines GROUP BY ALL""",
    "lines",
)
def vote_category(t: Views):
    return t.lines.groupBy("vote", v.vote_category(F.col("vote")).alias("vote_category")).agg(
        F.count("*").alias("n")
    )


@query(
    "norm_name",
    r"""SELECT MemberName AS raw_name, regexp_replace(trim(MemberName), '\s+', ' ', 'g') AS name,
         count(*) AS n FROM rollcall GROUP BY ALL""",
    "rollcall",
)
def norm_name(t: Views):
    return t.rollcall.groupBy(
        F.col("MemberName").alias("raw_name"), v.norm_name(F.col("MemberName")).alias("name")
    ).agg(F.count("*").alias("n"))


@query(
    "norm_position",
    """SELECT MemberPosition AS raw_position, CASE
         WHEN MemberPosition IN ('Mr.', 'Mrs.', 'Miss.', 'Advocate') THEN 'Deputy'
         WHEN MemberPosition = 'Senators' THEN 'Senator' ELSE MemberPosition END AS position,
         count(*) AS n FROM rollcall GROUP BY ALL""",
    "rollcall",
)
def norm_position(t: Views):
    return t.rollcall.groupBy(
        F.col("MemberPosition").alias("raw_position"),
        v.norm_position(F.col("MemberPosition")).alias("position"),
    ).agg(F.count("*").alias("n"))


PARSED = r"""parsed AS (SELECT *, CASE WHEN base = '' THEN clean ELSE base END AS base_ref FROM
  (SELECT *, regexp_extract(clean, '^P\.\d+/\d{4}') AS base FROM
    (SELECT *, CASE WHEN contains(Reference, '|') THEN trim(string_split(Reference, '|')[-1])
       ELSE Reference END AS clean FROM rollcall)))"""
SOURCE_URL = r"""CASE WHEN base <> '' THEN 'https://statesassembly.je/publications/propositions/'
  || regexp_extract(base, '/(\d{4})', 1) || '/p-' || regexp_extract(base, 'P\.(\d+)/', 1) || '-'
  || regexp_extract(base, '/(\d{4})', 1) END"""


@query(
    "parse_reference",
    rf""", {PARSED} SELECT Reference AS reference, base_ref, clean AS clean_ref,
        CASE WHEN base <> '' AND contains(clean, '(Amd)') THEN
          coalesce(try_cast(nullif(regexp_extract(clean, '\(Amd\)(?:\((\d+)\))?', 1), '') AS INTEGER), 1)
          END AS amendment_number,
        base <> '' AND regexp_matches(clean, '[Rr]e-?issue') AS is_reissue,
        {SOURCE_URL} AS source_url, count(*) AS n
        FROM parsed GROUP BY ALL""",
    "rollcall",
)
def parse_reference(t: Views):
    ref = v.parse_reference(F.col("Reference"))
    parsed = t.rollcall.groupBy(F.col("Reference").alias("reference")).agg(F.count("*").alias("n"))
    return parsed.withColumn("r", v.parse_reference(F.col("reference"))).select(
        "reference", "r.*", v.source_url(F.col("r.base_ref")).alias("source_url"), "n"
    )


STAGE_SQL = """CASE
  WHEN contains(lower(Title), 'principles')
    OR contains(string_split(lower(PropositionTitle), ')')[-1], 'principles') THEN 'principles'
  WHEN contains(lower(Title) || ' ' || lower(PropositionTitle), 'third reading') THEN 'third_reading'
  WHEN regexp_matches(lower(Title), 'articles?\\s+\\d') THEN 'articles'
  WHEN contains(lower(Title), 'amendment') OR contains(lower(Title), 'amd') THEN 'amendment'
  WHEN contains(lower(Title), 'paragraph') THEN 'paragraph'
  WHEN contains(lower(Title), 'regulation') THEN 'regulations'
  WHEN regexp_matches(lower(Title) || ' ' || lower(PropositionTitle),
    'closure|motion|refer back|standing order') THEN 'procedural'
  ELSE 'other' END""".replace("\\\\", "\\")


@query(
    "stage",
    f"""SELECT Title AS title, PropositionTitle AS proposition_title, {STAGE_SQL} AS division_stage,
          count(*) AS n FROM rollcall GROUP BY ALL""",
    "rollcall",
)
def stage(t: Views):
    return t.rollcall.groupBy(
        F.col("Title").alias("title"),
        F.col("PropositionTitle").alias("proposition_title"),
        v.stage(F.col("Title"), F.col("PropositionTitle")).alias("division_stage"),
    ).agg(F.count("*").alias("n"))


@query(
    "parse_date",
    f"""SELECT "Date" AS text, CAST({DATE} AS DATE) AS day, count(*) AS n FROM rollcall GROUP BY ALL""",
    "rollcall",
)
def parse_date(t: Views):
    return t.rollcall.groupBy(
        F.col("Date").alias("text"), F.to_date(v.parse_date(F.col("Date"))).alias("day")
    ).agg(F.count("*").alias("n"))


# --- ingest ---------------------------------------------------------------------

MEMBERS_SQL = f"""dated AS (SELECT regexp_replace(trim(MemberName), '\\s+', ' ', 'g') AS canonical_name,
    CASE WHEN MemberPosition IN ('Mr.', 'Mrs.', 'Miss.', 'Advocate') THEN 'Deputy'
         WHEN MemberPosition = 'Senators' THEN 'Senator' ELSE MemberPosition END AS position,
    {DATE} AS d, row_no FROM rollcall WHERE {DATE} IS NOT NULL),
  positions AS (SELECT canonical_name, position, count(*) AS n, min(row_no) AS first_row,
    min(d) AS d1, max(d) AS d2, bool_or(year(d) IN (2000, 2001)) AS active FROM dated GROUP BY ALL),
  member_rows AS (SELECT row_number() OVER (ORDER BY canonical_name) AS member_id, canonical_name,
    CAST(min(d1) AS DATE) AS first_vote, CAST(max(d2) AS DATE) AS last_vote, bool_or(active) AS is_currently_active,
    string_agg(position || ':' || n, '|' ORDER BY n DESC, first_row) AS position_history
    FROM positions GROUP BY canonical_name)"""


@query("build_members", f", {MEMBERS_SQL} SELECT * FROM member_rows", "rollcall")
def build_members(t: Views):
    members = ingest.build_members(t.rollcall, YEARS)
    history = F.transform(
        "position_history", lambda p: F.concat(p["position"], F.lit(":"), p["count"].cast("string"))
    )
    return members.select(
        "member_id",
        "canonical_name",
        F.to_date("first_vote_date").alias("first_vote"),
        F.to_date("last_vote_date").alias("last_vote"),
        "is_currently_active",
        F.array_join(history, "|").alias("position_history"),
    )


PROPS_SQL = rf"""{PARSED}, prop_rows AS (SELECT
    row_number() OVER (ORDER BY year, number, first_row) AS proposition_id, * EXCLUDE (first_row)
    FROM (SELECT base_ref AS base_reference,
      CASE WHEN any_value(base) <> '' THEN CAST(regexp_extract(any_value(base), '/(\d{{4}})', 1) AS INTEGER) ELSE 0 END AS year,
      CASE WHEN any_value(base) <> '' THEN CAST(regexp_extract(any_value(base), 'P\.(\d+)/', 1) AS INTEGER) ELSE 0 END AS number,
      {SOURCE_URL.replace("base", "any_value(base)")} AS source_url,
      arg_min(PropositionTitle, row_no) AS title, min(row_no) AS first_row
      FROM parsed GROUP BY base_ref))"""


@query("build_propositions", f", {PROPS_SQL} SELECT * FROM prop_rows", "rollcall")
def build_propositions(t: Views):
    return ingest.build_propositions(t.rollcall)


VOTES_SQL = rf"""{MEMBERS_SQL}, opened AS (SELECT ID, min(row_no) AS first_row FROM rollcall
    WHERE {DATE} IS NOT NULL GROUP BY ID),
  vote_rows AS (SELECT CAST(r.ID AS BIGINT) AS division_id, m.member_id, r.Vote AS vote
    FROM rollcall r JOIN opened o ON o.ID = r.ID AND r.row_no >= o.first_row
    JOIN member_rows m ON m.canonical_name = regexp_replace(trim(r.MemberName), '\s+', ' ', 'g')
    QUALIFY row_number() OVER (PARTITION BY r.ID, m.member_id ORDER BY
      CASE WHEN r.Vote IN ('Pour', 'Contre', 'Abstained') THEN 0 ELSE 1 END, r.row_no) = 1)"""


@query(
    "build_votes",
    f""", {VOTES_SQL} SELECT division_id, member_id, vote, CASE
          WHEN vote IN ('Pour', 'Contre', 'Abstained') THEN 'active_vote' WHEN vote = 'Ill' THEN 'excused_absence'
          WHEN vote IN ('Not present for vote', 'En défaut') THEN 'unexcused_absence' ELSE 'unknown' END
          AS vote_category,
          (SELECT CAST(year(min({DATE})) AS INTEGER) FROM rollcall r WHERE CAST(r.ID AS BIGINT) = division_id
             AND r.row_no = (SELECT first_row FROM opened o WHERE o.ID = r.ID)) AS year
        FROM vote_rows""",
    "rollcall",
)
def build_votes(t: Views):
    """All four tables built, written in order and read back."""
    root = new_path(t.spark, "tables")
    files.write_tables(ingest.build_all(t.rollcall, YEARS), root)
    return files.read_tables(t.spark, root)["votes"]


@query(
    "build_divisions",
    f""", {VOTES_SQL}, {PROPS_SQL},
      firsts AS (SELECT p.*, o.first_row FROM parsed p JOIN opened o ON o.ID = p.ID AND o.first_row = p.row_no),
      counts AS (SELECT division_id, count(*) FILTER (vote = 'Pour') AS pour_count,
        count(*) FILTER (vote = 'Contre') AS contre_count, count(*) FILTER (vote = 'Abstained') AS abstain_count,
        count(*) FILTER (vote NOT IN ('Pour', 'Contre', 'Abstained')) AS absent_count,
        count(*) AS total_eligible FROM vote_rows GROUP BY 1)
      SELECT CAST(ID AS BIGINT) AS division_id, pr.proposition_id, f.Title AS title,
        PropositionTitle AS proposition_title, clean AS reference, CAST({DATE} AS DATE) AS date,
        {STAGE_SQL.replace("Title", "f.Title").replace("Propositionf.Title", "f.PropositionTitle")} AS division_stage,
        CASE WHEN base <> '' AND contains(clean, '(Amd)') THEN
          coalesce(try_cast(nullif(regexp_extract(clean, '\\(Amd\\)(?:\\((\\d+)\\))?', 1), '') AS INTEGER), 1) END
          AS amendment_number,
        base <> '' AND regexp_matches(clean, '[Rr]e-?issue') AS is_reissue,
        pour_count, contre_count, abstain_count, absent_count, total_eligible
      FROM firsts f LEFT JOIN prop_rows pr ON pr.base_reference = f.base_ref
      JOIN counts c ON c.division_id = CAST(ID AS BIGINT)""".replace("\\\\", "\\"),
    "rollcall",
)
def build_divisions(t: Views):
    tables = ingest.build_all(t.rollcall, YEARS)
    return tables["divisions"].withColumn("date", F.to_date("date"))


@query("dedupe_votes", "SELECT * FROM votes", "votes")
def dedupe_votes(t: Views):
    return t.votes


@query("division_tallies", "SELECT * FROM tallies", "tallies")
def division_tallies(t: Views):
    return ingest.division_tallies(t.votes)


@query(
    "integrity",
    """SELECT 'unique votes(division_id, member_id)' AS rule, division_id || '|' || member_id AS key, count(*) AS n
         FROM votes_raw GROUP BY division_id, member_id HAVING count(*) > 1
       UNION ALL SELECT 'not null candidates(constituency)', 'null', count(*) FROM candidates
         WHERE constituency IS NULL HAVING count(*) > 0
       UNION ALL SELECT 'foreign votes(member_id)', CAST(member_id AS VARCHAR), count(*) FROM votes_raw
         WHERE member_id NOT IN (SELECT member_id FROM members WHERE is_currently_active) GROUP BY member_id
       UNION ALL SELECT 'unique members(canonical_name)', canonical_name, count(*) FROM members
         GROUP BY canonical_name HAVING count(*) > 1""",
    "votes_raw candidates members",
)
def integrity(t: Views):
    """Violations of the raw votes against the active members."""
    return ingest.integrity(
        {
            "votes": t.votes_raw,
            "members": t.members.where("is_currently_active"),
            "candidates": t.candidates,
        },
        {"votes": [["division_id", "member_id"]], "members": [["canonical_name"]]},
        {"candidates": ["constituency"], "votes": ["division_id", "member_id"]},
        [("votes", "member_id", "members", "member_id")],
    )


# --- reports ---------------------------------------------------------------------


@query(
    "member_list",
    """SELECT m.member_id, canonical_name, display_name, is_currently_active, main_position,
         first_vote_date AS first_date, last_vote_date AS last_date,
         count(*) FILTER (vote_category = 'active_vote') AS active_votes, count(*) AS total_divisions,
         count(v.member_id) AS total_votes, count(*) FILTER (vote = 'Pour') AS pour_count,
         count(*) FILTER (vote = 'Contre') AS contre_count
       FROM members m LEFT JOIN votes v ON v.member_id = m.member_id GROUP BY ALL""",
    "members votes",
)
def member_list(t: Views):
    return reports.member_list(t.members, t.votes)


@query(
    "member_totals",
    """SELECT member_id, count(*) AS total_divisions,
         count(*) FILTER (vote_category = 'active_vote') AS active_votes, count(*) FILTER (vote = 'Pour') AS pour,
         count(*) FILTER (vote = 'Contre') AS contre, count(*) FILTER (vote = 'Abstained') AS abstained,
         count(*) FILTER (vote_category = 'unexcused_absence') AS unexcused,
         count(*) FILTER (vote_category = 'excused_absence') AS excused,
         CAST(count(*) FILTER (vote_category = 'active_vote') AS DOUBLE) / count(*) * 100 AS participation_pct
       FROM votes GROUP BY member_id""",
    "votes",
)
def member_totals(t: Views):
    return reports.member_totals(t.votes)


@query(
    "member_topics",
    """SELECT member_id, topic_primary, count(*) AS count, count(*) FILTER (vote = 'Pour') AS pour,
         count(*) FILTER (vote = 'Contre') AS contre,
         CAST(count(*) FILTER (vote = 'Pour') AS DOUBLE) / count(*) * 100 AS pour_pct
       FROM votes JOIN divisions USING (division_id) JOIN props USING (proposition_id)
       WHERE vote IN ('Pour', 'Contre') AND topic_primary IS NOT NULL GROUP BY ALL""",
    "votes divisions props",
)
def member_topics(t: Views):
    return reports.member_topics(t.stored_votes, t.stored_divisions, t.props)


@query(
    "member_recent_votes",
    f"""SELECT division_id, member_id, vote, proposition_title, CAST(date AS DATE) AS date, pour_count,
          contre_count, division_stage, topic_primary,
          CAST(row_number() OVER (PARTITION BY member_id ORDER BY date DESC, division_id) AS INTEGER) AS place
        FROM votes JOIN divisions USING (division_id) JOIN props USING (proposition_id)
        WHERE vote IN ('Pour', 'Contre', 'Abstained') AND division_stage IN {KEY_STAGES}
        QUALIFY place <= 20""",
    "votes divisions props",
)
def member_recent_votes(t: Views):
    latest = reports.member_recent_votes(t.stored_votes, t.stored_divisions, t.props)
    return latest.withColumn("date", F.to_date("date"))


@query(
    "recent_votes",
    f"""SELECT division_id, proposition_title, CAST(date AS DATE) AS date, reference, pour_count, contre_count,
          division_stage, topic_primary, source_url
        FROM divisions JOIN props USING (proposition_id) WHERE division_stage IN {KEY_STAGES}
        ORDER BY divisions.date DESC, division_id LIMIT 6""",
    "divisions props",
)
def recent_votes(t: Views):
    return reports.recent_votes(t.divisions, t.props).select(
        "division_id",
        "proposition_title",
        F.to_date("date").alias("date"),
        "reference",
        "pour_count",
        "contre_count",
        "division_stage",
        "topic_primary",
        "source_url",
    )


@query(
    "vote_list",
    """, matches AS (SELECT *, count(*) OVER () AS total FROM divisions JOIN props USING (proposition_id)
          WHERE topic_primary = 'ECONOMY' AND division_stage = 'amendment')
        SELECT division_id, proposition_title, CAST(date AS DATE) AS date, pour_count, contre_count,
          topic_primary, plain_language_summary, pour_count > contre_count AS passed, total,
          CAST(ceil(total / 30) AS BIGINT) AS pages
        FROM matches ORDER BY matches.date DESC, division_id LIMIT 30 OFFSET 30""",
    "divisions props",
)
def vote_list(t: Views):
    page = reports.vote_list(t.divisions, t.props, topic="ECONOMY", stage="amendment", page=2)
    return page.select(
        "division_id",
        "proposition_title",
        F.to_date("date").alias("date"),
        "pour_count",
        "contre_count",
        "topic_primary",
        "plain_language_summary",
        "passed",
        "total",
        "pages",
    )


@query(
    "division_rollcall",
    """SELECT division_id, member_id, canonical_name, main_position AS position, vote, vote_category,
         CASE WHEN vote IN ('Pour', 'Contre', 'Abstained') THEN vote
              WHEN vote IN ('Not present for vote', 'En défaut') THEN 'Not Present'
              WHEN vote = 'Ill' THEN 'Other' END AS heading
       FROM votes JOIN members USING (member_id)""",
    "votes members",
)
def division_rollcall(t: Views):
    return reports.division_rollcall(t.votes, t.members)


CLOSENESS = "CAST(least(pour_count, contre_count) AS DOUBLE) / nullif(pour_count + contre_count, 0)"


@query(
    "topic_divisiveness",
    f"""SELECT topic_primary, count(*) AS vote_count, round(avg({CLOSENESS}), 9) AS avg_closeness
        FROM divisions JOIN props USING (proposition_id)
        WHERE division_stage IN {WIDE_STAGES} AND topic_primary IS NOT NULL
          AND pour_count + contre_count >= 10 AND date >= TIMESTAMP '{SINCE}'
        GROUP BY topic_primary HAVING count(*) >= 3""",
    "divisions props",
)
def topic_divisiveness(t: Views):
    found = reports.topic_divisiveness(t.divisions, t.props, SINCE)
    return found.withColumn("avg_closeness", F.round("avg_closeness", 9))


@query(
    "closest_votes",
    f"""SELECT division_id, proposition_title, CAST(date AS DATE) AS date, pour_count, contre_count,
          division_stage, base_reference, topic_primary, plain_language_summary, closeness
        FROM (SELECT *, {CLOSENESS} AS closeness FROM divisions JOIN props USING (proposition_id)
          WHERE division_stage IN {WIDE_STAGES} AND pour_count + contre_count >= 20
            AND date >= TIMESTAMP '{SINCE}'
          QUALIFY row_number() OVER (PARTITION BY proposition_id ORDER BY {CLOSENESS} DESC, division_id) = 1) x
        ORDER BY closeness DESC, division_id LIMIT 25""",
    "divisions props",
)
def closest_votes(t: Views):
    return reports.closest_votes(t.divisions, t.props, SINCE).select(
        "division_id",
        "proposition_title",
        F.to_date("date").alias("date"),
        "pour_count",
        "contre_count",
        "division_stage",
        "base_reference",
        "topic_primary",
        "plain_language_summary",
        "closeness",
    )


@query(
    "polarisation",
    f"""SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS vote_count,
          round(avg({CLOSENESS}), 9) AS avg_closeness
        FROM divisions WHERE division_stage IN {WIDE_STAGES} AND pour_count + contre_count >= 10 GROUP BY 1""",
    "divisions",
)
def polarisation(t: Views):
    return reports.polarisation(t.divisions).withColumn("avg_closeness", F.round("avg_closeness", 9))


@query(
    "topic_counts",
    f"""SELECT topic_primary, count(DISTINCT division_id) AS vote_count
        FROM divisions JOIN props USING (proposition_id) WHERE topic_primary IS NOT NULL
          AND division_stage IN {KEY_STAGES} AND date >= TIMESTAMP '{SINCE}' GROUP BY 1""",
    "divisions props",
)
def topic_counts(t: Views):
    return reports.topic_counts(t.divisions, t.props, SINCE)


@query(
    "topic_list", "SELECT DISTINCT topic_primary FROM props WHERE topic_primary IS NOT NULL", "props"
)
def topic_list(t: Views):
    return reports.topic_list(t.props)


@query(
    "breakdowns",
    """SELECT 'stage' AS kind, division_stage AS label, count(*) AS n FROM divisions GROUP BY ALL
       UNION ALL SELECT 'category', vote_category, count(*) FROM votes GROUP BY ALL
       UNION ALL SELECT 'topic', coalesce(topic_primary, 'UNCLASSIFIED'), count(*) FROM props GROUP BY ALL""",
    "divisions votes props",
)
def breakdowns(t: Views):
    return reports.breakdowns(
        stage=(t.stored_divisions, "division_stage"),
        category=(t.stored_votes, "vote_category"),
        topic=(t.props, "topic_primary"),
    )


# --- alignment --------------------------------------------------------------------

VALUES = f"""cells AS (SELECT member_id, division_id,
    CASE vote WHEN 'Pour' THEN 1 WHEN 'Contre' THEN -1 ELSE 0 END AS v
  FROM votes JOIN divisions USING (division_id) JOIN members USING (member_id)
  WHERE vote IN ('Pour', 'Contre', 'Abstained') AND is_currently_active
    AND division_stage IN {KEY_STAGES} AND date >= TIMESTAMP '{SINCE}')"""
PAIRS = f"""{VALUES}, active AS (SELECT * FROM members WHERE is_currently_active),
  met AS (SELECT a.member_id AS m1, b.member_id AS m2, count(*) AS shared,
    count(*) FILTER (a.v = b.v) AS agreed, sum(a.v * b.v) AS dot
    FROM cells a JOIN cells b ON a.division_id = b.division_id AND a.member_id <= b.member_id
    WHERE a.v <> 0 AND b.v <> 0 GROUP BY ALL),
  pairs AS (SELECT a.member_id AS m1, b.member_id AS m2, a.canonical_name AS name1, b.canonical_name AS name2,
      coalesce(agreed, 0) AS agreed, coalesce(shared, 0) AS shared, coalesce(dot, 0) AS dot
    FROM active a JOIN active b ON a.member_id <= b.member_id
    LEFT JOIN met ON m1 = a.member_id AND m2 = b.member_id)"""


def matrix(t: Views):
    """The values, rows and columns of the vote matrix."""
    active = t.members.where("is_currently_active")
    divisions = t.stored_divisions
    chosen = al.eligible_divisions(divisions, SINCE)
    return al.vote_values(t.stored_votes, divisions, t.members, SINCE), active, chosen


@query("vote_matrix", f", {VALUES} SELECT * FROM cells", "votes divisions members")
def vote_matrix(t: Views):
    return matrix(t)[0]


@query(
    "alignment",
    f""", {PAIRS} SELECT m1, m2, agreed, shared, CAST(agreed AS DOUBLE) / nullif(shared, 0) AS pct FROM pairs""",
    "votes divisions members",
)
def alignment(t: Views):
    return al.alignment(*matrix(t), strangers=True)


@query(
    "aligned_pairs",
    f""", {PAIRS}, scored AS (SELECT name1, name2, CAST(agreed AS DOUBLE) / shared AS pct, shared FROM pairs
          WHERE m1 < m2 AND shared >= 5)
        (SELECT 'most' AS side, * FROM scored ORDER BY pct DESC, name1, name2 LIMIT 15)
        UNION ALL (SELECT 'least' AS side, * FROM scored ORDER BY pct, name1, name2 LIMIT 15)""",
    "votes divisions members",
)
def aligned_pairs(t: Views):
    """The flagship: dedupe, tally, align, and report the extremes."""
    values, active, chosen = matrix(t)
    pairs = al.alignment(values, active, chosen, strangers=False)
    return al.aligned_pairs(pairs, active, min_shared=5)


@query(
    "cosine",
    f""", {PAIRS}, norms AS (SELECT member_id, count(*) AS n FROM cells WHERE v <> 0 GROUP BY 1)
        SELECT m1, m2, round(coalesce(dot / sqrt(x.n * y.n), 0), 9) AS similarity FROM pairs
        LEFT JOIN norms x ON x.member_id = m1 LEFT JOIN norms y ON y.member_id = m2""",
    "votes divisions members",
)
def cosine(t: Views):
    return al.cosine(*matrix(t), strangers=True).withColumn("similarity", F.round("similarity", 9))


@query(
    "independence",
    f""", {VALUES}, judged AS (SELECT member_id, count(*) AS total,
          count(*) FILTER (v <> CASE WHEN pour_count >= contre_count THEN 1 ELSE -1 END) AS dissent
          FROM cells JOIN divisions USING (division_id) WHERE v <> 0 GROUP BY 1)
        SELECT m.member_id, canonical_name, coalesce(dissent, 0) AS dissent_count,
          coalesce(total, 0) AS total_active_votes,
          coalesce(CAST(dissent AS DOUBLE) / total, 0) AS dissent_rate
        FROM members m LEFT JOIN judged j USING (member_id) WHERE is_currently_active""",
    "votes divisions members",
)
def independence(t: Views):
    values, active, chosen = matrix(t)
    return al.independence(values, chosen, active)


@query(
    "participation",
    f"""SELECT canonical_name, count(*) AS total_divisions,
          count(*) FILTER (vote_category = 'active_vote') AS active_votes,
          count(*) FILTER (vote_category = 'excused_absence') AS excused_absences,
          count(*) FILTER (vote_category = 'unexcused_absence') AS unexcused_absences,
          count(*) FILTER (vote = 'Abstained') AS abstentions,
          CAST(count(*) FILTER (vote_category = 'active_vote') AS DOUBLE) / count(*) AS participation_rate,
          CAST(count(*) FILTER (vote_category = 'unexcused_absence') AS DOUBLE) / count(*) AS unexcused_rate
        FROM votes JOIN members USING (member_id) JOIN divisions USING (division_id)
        WHERE is_currently_active AND date >= TIMESTAMP '{SINCE}' GROUP BY canonical_name""",
    "votes members divisions",
)
def participation(t: Views):
    return al.participation(t.stored_votes, t.members, t.stored_divisions, SINCE)


# --- respondents ------------------------------------------------------------------


@query(
    "quiz_questions",
    f"""RECURSIVE {{views}}, pool AS (SELECT *, row_number() OVER (ORDER BY
          abs(CAST(pour_count AS DOUBLE) / (pour_count + contre_count) - 0.5), division_id) AS rn,
          abs(CAST(pour_count AS DOUBLE) / (pour_count + contre_count) - 0.5) AS distance
        FROM divisions JOIN props USING (proposition_id)
        WHERE division_stage IN {WIDE_STAGES} AND date >= TIMESTAMP '{SINCE}' AND pour_count + contre_count >= 20
          AND {CLOSENESS} >= 0.25 AND topic_primary IS NOT NULL QUALIFY rn <= 200),
      walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS picked, CAST([] AS VARCHAR[]) AS seen,
          CAST([] AS VARCHAR[]) AS topics
        UNION ALL SELECT rn, CASE WHEN take THEN list_append(picked, division_id) ELSE picked END,
          CASE WHEN take THEN seen || [head, base_reference] ELSE seen END,
          CASE WHEN take THEN list_append(topics, topic_primary) ELSE topics END
        FROM (SELECT p.rn, picked, seen, topics, division_id, base_reference, topic_primary,
            proposition_title[1:30] AS head,
            NOT list_contains(seen, proposition_title[1:30]) AND NOT list_contains(seen, base_reference)
              AND len(list_filter(topics, lambda x: x = topic_primary)) < 4 AND len(picked) < 30 AS take
          FROM walk JOIN pool p ON p.rn = walk.rn + 1)),
      chosen AS (SELECT unnest(picked) AS division_id, generate_subscripts(picked, 1) AS position
        FROM (SELECT picked FROM walk ORDER BY rn DESC LIMIT 1))
      SELECT CAST(position AS INTEGER) AS position, distance, division_id, proposition_title AS title,
        coalesce(nullif(plain_language_summary, ''), CASE WHEN extended_summary IS NOT NULL
          THEN 'Because of ' || split_part(split_part(extended_summary, 'Because of ', 2), chr(10), 1) END,
          plain_language_summary) AS summary,
        topic_primary AS topic, base_reference AS reference, source_url, CAST(date AS DATE) AS date, pour_count,
        contre_count, pour_count > contre_count AS passed
      FROM chosen JOIN pool USING (division_id)""",
    "divisions props",
)
def quiz_questions(t: Views):
    return scoring.quiz_questions(t.divisions, t.props, SINCE)


@query(
    "respondent_match",
    """SELECT respondent_id, member_id, canonical_name AS name, main_position AS position,
         CAST(count(*) FILTER (x.same) AS DOUBLE) / count(*) AS agreement_pct,
         count(*) FILTER (x.same) AS agreed, count(*) AS total,
         CAST(row_number() OVER (PARTITION BY respondent_id
           ORDER BY CAST(count(*) FILTER (x.same) AS DOUBLE) / count(*) DESC, member_id) AS INTEGER) AS rank
       FROM (SELECT a.respondent_id, v.member_id, (a.vote = 'pour') = (v.vote = 'Pour') AS same
             FROM division_answers a JOIN votes v USING (division_id) WHERE v.vote IN ('Pour', 'Contre')) x
       JOIN members USING (member_id) WHERE is_currently_active
       GROUP BY respondent_id, member_id, canonical_name, main_position HAVING count(*) >= 3""",
    "division_answers votes members",
)
def respondent_match(t: Views):
    return scoring.respondent_match(
        t.division_answers, t.stored_votes, t.members, t.table("part")
    )


# --- spectrum ---------------------------------------------------------------------


def axes_sql(cells: str, k: int, scale: str = "1") -> str:
    """The first k principal axes of active members, by squaring the matrix of products.

    `cells` selects (member_id, division_id, v). A power of a matrix turns to its first axis; the
    axis is taken out and the rest is squared again. `scale` divides the coordinates.
    """
    parts = [
        f"""cells AS MATERIALIZED ({cells}),
  people AS MATERIALIZED (SELECT member_id, canonical_name FROM members WHERE is_currently_active),
  raw AS MATERIALIZED (SELECT x.member_id AS a, y.member_id AS b, coalesce(g, 0) AS g FROM people x CROSS JOIN people y
    LEFT JOIN (SELECT p.member_id AS pa, q.member_id AS qa, CAST(sum(p.v * q.v) AS DOUBLE) AS g FROM cells p
      JOIN cells q USING (division_id) GROUP BY ALL) ON pa = x.member_id AND qa = y.member_id),
  g1 AS MATERIALIZED (SELECT a, b, g - avg(g) OVER (PARTITION BY a) - avg(g) OVER (PARTITION BY b) + avg(g) OVER () AS g FROM raw)"""
    ]
    for c in range(1, k + 1):
        parts.append(
            f"s{c}_0 AS MATERIALIZED (SELECT a, b, g / greatest((SELECT sum(g) FROM g{c} WHERE a = b), 1e-300) AS g FROM g{c})"
        )
        for i in range(1, 14):
            parts.append(
                f"""t{c}_{i} AS MATERIALIZED (SELECT x.a, y.b, sum(x.g * y.g) AS g FROM s{c}_{i - 1} x JOIN s{c}_{i - 1} y ON y.a = x.b GROUP BY ALL),
  s{c}_{i} AS MATERIALIZED (SELECT a, b, g / greatest((SELECT sum(g) FROM t{c}_{i} WHERE a = b), 1e-300) AS g FROM t{c}_{i})"""
            )
        parts.append(
            f"""v{c} AS MATERIALIZED (SELECT a, g / sqrt(sum(g * g) OVER ()) AS x FROM s{c}_13
    WHERE b = (SELECT arg_max(a, g) FROM s{c}_13 WHERE a = b)),
  l{c} AS MATERIALIZED (SELECT sum(g * p.x * q.x) AS l FROM g{c} JOIN v{c} p ON p.a = g{c}.a JOIN v{c} q ON q.a = g{c}.b),
  c{c} AS MATERIALIZED (SELECT a, x * sqrt(l) / {scale} * (SELECT sign(arg_max(x, abs(x))) FROM v{c}) AS pc FROM v{c}, l{c}),
  g{c + 1} AS MATERIALIZED (SELECT g{c}.a, g{c}.b, g - l * p.x * q.x AS g FROM g{c} JOIN v{c} p ON p.a = g{c}.a
    JOIN v{c} q ON q.a = g{c}.b CROSS JOIN l{c})"""
        )
    return ",\n  ".join(parts)


def rounded(df, *columns: str):
    """Coordinates to four places: what any exact solution agrees on."""
    return df.withColumns({c: F.round(c, 4) + 0.0 for c in columns})


TOPIC_CELLS = f"""SELECT member_id, division_id, CASE vote WHEN 'Pour' THEN 1 ELSE -1 END AS v FROM votes
    JOIN divisions USING (division_id) JOIN props USING (proposition_id) JOIN members USING (member_id)
    WHERE is_currently_active AND vote IN ('Pour', 'Contre') AND date >= '{SINCE}' AND division_stage IN {KEY_STAGES}
      AND topic_primary IN ('{PART_TYPES[0]}', '{PART_TYPES[1]}')"""


@query(
    "pca_members",
    f""", {axes_sql(f"""SELECT member_id, division_id, CASE vote WHEN 'Pour' THEN 1 ELSE -1 END AS v FROM votes
    JOIN divisions USING (division_id) JOIN members USING (member_id)
    WHERE is_currently_active AND vote IN ('Pour', 'Contre') AND date >= '{SINCE}' AND division_stage IN {KEY_STAGES}""", 3)}
      SELECT member_id, canonical_name, round(c1.pc, 4) + 0.0 AS pc1, round(c2.pc, 4) + 0.0 AS pc2, round(c3.pc, 4) + 0.0 AS pc3
      FROM people JOIN c1 ON c1.a = member_id JOIN c2 ON c2.a = member_id JOIN c3 ON c3.a = member_id""",
    "votes divisions members",
)
def pca_members(t: Views):
    values, active, _ = matrix(t)
    return rounded(spectrum.positions(values, active, 3).rows, "pc1", "pc2", "pc3")


def topic_points(t: Views):
    """Two-dimensional positions on two topics."""
    active = t.members.where("is_currently_active")
    of_topic = t.stored_divisions.join(t.props.select("proposition_id", "topic_primary"), "proposition_id")
    values = al.vote_values(t.stored_votes, of_topic, t.members, SINCE, topics=PART_TYPES[:2])
    placed = spectrum.positions(values.where("v <> 0"), active, 2, "gram").rows
    return placed.withColumnsRenamed({"pc1": "x", "pc2": "y"})


POINTS_SQL = f"""{axes_sql(TOPIC_CELLS, 2, "sqrt((SELECT count(DISTINCT division_id) FROM cells))")},
  points AS MATERIALIZED (SELECT member_id, canonical_name, c1.pc AS x, c2.pc AS y
    FROM people JOIN c1 ON c1.a = member_id JOIN c2 ON c2.a = member_id)"""


@query(
    "pca_by_topic",
    f", {POINTS_SQL} SELECT member_id, canonical_name, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM points",
    "votes divisions members props",
)
def pca_by_topic(t: Views):
    return rounded(topic_points(t), "x", "y")


# Each round names the nearest of five centres for every point and takes their means; a bloc
# without points moves to the origin.
BLOCS_SQL = f""" RECURSIVE {{views}}, {POINTS_SQL},
  numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY x, canonical_name, member_id) - 1 AS i FROM points),
  starts AS (SELECT c, x AS cx, y AS cy FROM numbered JOIN (SELECT unnest(range(5)) AS c) ON i = floor(c / 4.0 * (SELECT count(*) - 1 FROM numbered))),
  rounds AS (SELECT 0 AS round, list(struct_pack(c := c, x := cx, y := cy) ORDER BY c) AS centres FROM starts
    UNION ALL
    SELECT round + 1, (SELECT list(struct_pack(c := c, x := coalesce(mx, 0), y := coalesce(my, 0)) ORDER BY c)
      FROM (SELECT unnest(range(5)) AS c) LEFT JOIN (SELECT near, avg(x) AS mx, avg(y) AS my FROM (
        SELECT x, y, list_sort(list_transform(centres, lambda k: struct_pack(d := (x - k.x) * (x - k.x) + (y - k.y) * (y - k.y), c := k.c)))[1].c AS near
        FROM numbered) GROUP BY near) ON near = c)
    FROM rounds WHERE round < 49),
  blocs AS (SELECT member_id, canonical_name, x, y,
    list_sort(list_transform(centres, lambda k: struct_pack(d := (x - k.x) * (x - k.x) + (y - k.y) * (y - k.y), c := k.c)))[1].c AS bloc
    FROM numbered CROSS JOIN (SELECT centres FROM rounds WHERE round = 49))"""


@query(
    "blocs",
    f"{BLOCS_SQL} SELECT member_id, canonical_name, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, CAST(bloc AS INTEGER) AS bloc FROM blocs",
    "votes divisions members props",
)
def blocs(t: Views):
    return rounded(spectrum.blocs(topic_points(t)), "x", "y")


@query(
    "bloc_roster",
    f"""{BLOCS_SQL} SELECT CAST(bloc AS INTEGER) AS bloc, member_id, canonical_name, count(*) OVER (PARTITION BY bloc) AS size FROM blocs""",
    "votes divisions members props",
)
def bloc_roster(t: Views):
    return spectrum.bloc_roster(spectrum.blocs(topic_points(t)))


@query("hier_blocs")
def hier_blocs(t: Views):
    return spectrum.hier_blocs(*matrix(t))
