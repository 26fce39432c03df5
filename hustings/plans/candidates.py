"""Queries over candidates, questions, stances and their exports."""

from pyspark.sql import functions as F

from hustings.operators import annotate, exports, reports, scoring
from hustings.operators.ids import dense_ids
from hustings.plans.fixtures import PART_TYPES, Views
from hustings.plans.registry import query
from hustings.session import new_path
from hustings.sources import files

AREAS = {f"NATION_{i}": [f"NATION_{i}", f"NATION_{(i + 5) % 25}"] for i in range(10)}


def scored_candidates(t: Views):
    return reports.current(t.candidates).where("classified_at IS NOT NULL")


def round2(x: str) -> str:
    return f"floor(({x}) * 100 + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE)"


MATCH = f"""w AS (SELECT respondent_id, place, topic, CAST(6 - place AS DOUBLE) AS w FROM priorities),
  cand AS (SELECT * FROM candidates WHERE opted_out_at IS NULL AND classified_at IS NOT NULL),
  held AS (SELECT s.candidate_id, s.question_id, coalesce(corrected_stance, stance) AS stance, q.topic
    FROM stances s JOIN questions q USING (question_id) JOIN cand USING (candidate_id)),
  per_topic AS (SELECT respondent_id, candidate_id,
    {" + ".join(f"coalesce(max(CASE WHEN place = {p} THEN w * salience END), 0)" for p in range(1, 6))} AS t_num
    FROM w JOIN candidate_topics ct USING (topic) GROUP BY ALL),
  credit AS (SELECT a.respondent_id, h.candidate_id, coalesce(w.w, 1) AS wq,
    CASE WHEN h.stance = 'not_addressed' THEN NULL
         WHEN h.stance = a.answer THEN 1
         WHEN h.stance = 'neutral' OR a.answer = 'neutral' THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS m
    FROM answers a JOIN held h USING (question_id)
    LEFT JOIN w ON w.respondent_id = a.respondent_id AND w.topic = h.topic
    WHERE a.answer IN ('agree', 'disagree', 'neutral')),
  per_answer AS (SELECT respondent_id, candidate_id, sum(wq * m) AS s_num,
    sum(wq) FILTER (m IS NOT NULL) AS s_den, count(m) AS overlap, count(*) FILTER (m = 1) AS matched,
    count(*) AS answered FROM credit GROUP BY ALL),
  addressed AS (SELECT respondent_id, candidate_id, count(*) AS n FROM w JOIN held h USING (topic)
    WHERE stance <> 'not_addressed' GROUP BY ALL),
  asked AS (SELECT respondent_id, count(question_id) AS n FROM w LEFT JOIN questions USING (topic) GROUP BY ALL),
  weights AS (SELECT respondent_id, sum(w) AS w_sum FROM w GROUP BY 1),
  raw AS (SELECT u.respondent_id, c.candidate_id, c.full_name AS name, c.role, c.constituency,
      coalesce(t_num, 0) / w_sum AS t, coalesce(s_num / nullif(s_den, 0), 0) AS s_raw,
      coalesce(overlap, 0) AS overlap, coalesce(matched, 0) AS matched, coalesce(answered, 0) AS answered,
      CASE WHEN asked.n > 0 THEN CAST(coalesce(ad.n, 0) AS DOUBLE) / asked.n ELSE 0 END AS c
    FROM weights u CROSS JOIN cand c JOIN asked USING (respondent_id)
    LEFT JOIN per_topic USING (respondent_id, candidate_id)
    LEFT JOIN per_answer USING (respondent_id, candidate_id)
    LEFT JOIN addressed ad USING (respondent_id, candidate_id)),
  shrunk AS (SELECT *, s_raw * least(CAST(1 AS DOUBLE), CAST(overlap AS DOUBLE) / 8) AS s FROM raw),
  scored AS (SELECT respondent_id, candidate_id, name, role, constituency, {round2("t")} AS "T", {round2("s")} AS "S",
      {round2("s_raw")} AS "S_raw", {round2("c")} AS "C",
      {round2("CAST(0.4 AS DOUBLE) * t + CAST(0.6 AS DOUBLE) * s")} AS match,
      matched AS matched_questions, answered AS answered_questions, overlap AS overlap_count,
      c < CAST(0.4 AS DOUBLE) AS low_coverage FROM shrunk)"""
RANKED = """SELECT * EXCLUDE (role, constituency), CAST(row_number() OVER (PARTITION BY respondent_id
    ORDER BY low_coverage, floor(match * 100 + CAST(0.5 AS DOUBLE)) DESC, "S" DESC, name, candidate_id)
    AS INTEGER) AS rank"""
MATCH_VIEWS = "priorities candidates stances questions candidate_topics answers"


def matched(t: Views, **more):
    return scoring.candidate_match(
        t.priorities,
        t.answers,
        scored_candidates(t),
        t.candidate_topics,
        t.stances,
        t.questions,
        PART_TYPES,
        **more,
    )


@query("candidate_match", f", {MATCH} {RANKED} FROM scored", MATCH_VIEWS)
def candidate_match(t: Views):
    return matched(t)


IN_AREA = " OR ".join(
    f"(area = '{a}' AND (constituency IN ({', '.join(repr(x) for x in xs)}) OR role = 'Senator'))"
    for a, xs in AREAS.items()
)


@query(
    "candidate_match_area",
    f""", {MATCH}, places AS (SELECT c_custkey AS respondent_id, CASE WHEN c_nationkey % 5 <> 4
          THEN 'NATION_' || c_nationkey END AS area FROM customer)
        {RANKED.replace("* EXCLUDE (role, constituency)", "s.* EXCLUDE (role, constituency)")}
        FROM scored s LEFT JOIN places USING (respondent_id)
        WHERE area IS NULL OR {IN_AREA} OR (area NOT IN ({', '.join(repr(a) for a in AREAS)})
          AND constituency = area)""",
    MATCH_VIEWS,
)
def candidate_match_area(t: Views):
    nation = F.col("c_nationkey")
    places = t.table("customer").select(
        F.col("c_custkey").alias("respondent_id"),
        F.when(nation % 5 != 4, F.concat(F.lit("NATION_"), nation.cast("string"))).alias("area"),
    )
    return matched(t, areas=places, area_map=AREAS)


@query(
    "area_filter",
    """SELECT candidate_id, full_name, role, constituency FROM candidates
       WHERE constituency IN ('NATION_3', 'NATION_8') OR role = 'Senator'""",
    "candidates",
)
def area_filter(t: Views):
    return scoring.area_filter(t.candidates, "NATION_3", AREAS).select(
        "candidate_id", "full_name", "role", "constituency"
    )


LISTED = "candidate_id, slug, full_name, role, constituency, party, scrape_status"


@query(
    "candidate_list",
    f""", tops AS (SELECT candidate_id, string_agg(topic, '|' ORDER BY place) AS topics FROM
          (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY salience DESC NULLS FIRST, topic)
             AS place FROM candidate_topics) WHERE place <= 4 GROUP BY 1)
        SELECT {LISTED}, topics FROM candidates LEFT JOIN tops USING (candidate_id)
        WHERE opted_out_at IS NULL AND (constituency IN ('NATION_3', 'NATION_8') OR role = 'Senator')
          AND full_name ILIKE '%supplier#%0%' AND EXISTS (SELECT 1 FROM candidate_topics ct
            WHERE ct.candidate_id = candidates.candidate_id AND ct.topic = 'PROMO')""",
    "candidates candidate_topics",
)
def candidate_list(t: Views):
    listed = reports.candidate_list(
        t.candidates,
        t.candidate_topics,
        area="NATION_3",
        topic="PROMO",
        q="supplier#%0",
        areas=AREAS,
    )
    return listed.select(*LISTED.split(", "), F.array_join("topics", "|").alias("topics"))


@query(
    "filter_options",
    """SELECT DISTINCT 'constituency' AS kind, constituency AS value FROM candidates
         WHERE opted_out_at IS NULL AND constituency IS NOT NULL
       UNION ALL SELECT DISTINCT 'role', role FROM candidates WHERE opted_out_at IS NULL
       UNION ALL SELECT DISTINCT 'party', party FROM candidates WHERE opted_out_at IS NULL
       UNION ALL SELECT DISTINCT 'topic', topic FROM candidate_topics""",
    "candidates candidate_topics",
)
def filter_options(t: Views):
    return reports.filter_options(t.candidates, t.candidate_topics)


@query(
    "candidate_profile",
    """SELECT candidate_id, slug, full_name, party, m.canonical_name AS incumbent_canonical_name,
         m.display_name AS incumbent_display_name
       FROM candidates c LEFT JOIN members m ON m.member_id = c.incumbent_member_id
       WHERE opted_out_at IS NULL""",
    "candidates members",
)
def candidate_profile(t: Views):
    return reports.candidate_profile(t.candidates, t.members).select(
        "candidate_id",
        "slug",
        "full_name",
        "party",
        "incumbent_canonical_name",
        "incumbent_display_name",
    )


@query(
    "stance_grid",
    """SELECT s.*, topic, statement, sort_order, coalesce(corrected_stance, stance) AS effective_stance
       FROM stances s JOIN questions USING (question_id)""",
    "stances questions",
)
def stance_grid(t: Views):
    return reports.stance_grid(t.stances, t.questions)


@query(
    "topic_examples",
    """SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY sort_order, question_id) AS INTEGER)
         AS place, statement FROM questions QUALIFY place <= 2""",
    "questions",
)
def topic_examples(t: Views):
    return reports.topic_examples(t.questions)


@query(
    "question_coverage",
    """SELECT question_id, topic, count(*) AS candidates,
         count(*) FILTER (stance <> 'not_addressed') AS addressed,
         CAST(count(*) FILTER (stance <> 'not_addressed') AS DOUBLE) / count(*) AS coverage,
         CAST(count(*) FILTER (stance <> 'not_addressed') AS DOUBLE) / count(*) < 0.05 AS retire
       FROM stances JOIN questions USING (question_id) GROUP BY question_id, topic""",
    "stances questions",
)
def question_coverage(t: Views):
    return scoring.question_coverage(t.stances, t.questions)


@query(
    "read_questions",
    """SELECT question_id, topic, statement, CAST(NULL AS VARCHAR) AS explainer, 2026 AS election_year,
         CAST(row_number() OVER (ORDER BY question_id) - 1 AS INTEGER) AS sort_order FROM questions""",
    "questions",
)
def read_questions(t: Views):
    """The questions written as a question set, a line each with its place, and read again."""
    listed = dense_ids(t.questions.select("question_id", "topic", "statement"), ["question_id"], "sort_order", start=0)
    path = new_path(t.spark, "question-set")
    files.write_question_lines(listed, path)
    return files.read_question_lines(t.spark, path)


@query(
    "question_check",
    """SELECT question_id, topic, topic <> 'PROMO' AS known FROM questions""",
    "questions",
)
def question_check(t: Views):
    """Questions against a vocabulary that lacks one of their topics."""
    topics = t.table("part").select(F.col("p_type").alias("topic")).where("topic <> 'PROMO'")
    valid, unknown = files.check_questions(t.questions, topics)
    return (
        valid.withColumn("known", F.lit(True))
        .unionByName(unknown.withColumn("known", F.lit(False)))
        .select("question_id", "topic", "known")
    )


@query(
    "headline",
    """SELECT (SELECT count(*) FROM members WHERE is_currently_active) AS active_members,
         (SELECT count(*) FROM props) AS total_propositions, (SELECT count(*) FROM divisions) AS total_divisions,
         (SELECT count(*) FROM questions) AS questions, count(*) AS total_candidates,
         count(incumbent_member_id) AS incumbents, count(DISTINCT constituency) AS constituency_count,
         count(classified_at) AS classified, count(*) FILTER (scrape_status = 'low_content') AS low_content,
         CAST(max(scraped_at) AS DATE) AS last_scrape
       FROM candidates WHERE opted_out_at IS NULL""",
    "members props divisions questions candidates",
)
def headline(t: Views):
    return reports.headline(t.members, t.props, t.divisions, t.candidates, t.questions).withColumn(
        "last_scrape", F.to_date("last_scrape")
    )


REVIEW = """review AS (SELECT candidate_id, full_name, coalesce(role, '') AS role,
    coalesce(constituency, '') AS constituency, coalesce(party, '') AS party, coalesce(email, '') AS email,
    coalesce('https://votes.example.org/candidates/correction/' || correction_token, '') AS preview_url,
    coalesce(correction_state, 'pending') AS correction_state,
    coalesce(manifesto_word_count, 0) AS manifesto_word_count,
    CASE WHEN classified_at IS NULL THEN 'no' ELSE 'yes' END AS classified,
    CASE WHEN enhanced_manifesto_status = 'found' THEN 'yes' ELSE 'no' END AS enhanced_manifesto_found,
    CASE WHEN enhanced_manifesto_status = 'found' THEN coalesce(enhanced_manifesto_source_url, '') ELSE '' END
      AS enhanced_manifesto_url,
    CASE WHEN enhanced_manifesto_status = 'found' THEN coalesce(enhanced_manifesto_source_label, '') ELSE '' END
      AS enhanced_manifesto_source,
    CASE WHEN enhanced_manifesto_status = 'found' THEN coalesce(enhanced_manifesto_word_count, 0) ELSE 0 END
      AS enhanced_manifesto_word_count
    FROM candidates)"""
SITE = "https://votes.example.org"


@query("review_export", f", {REVIEW} SELECT * FROM review", "candidates")
def review_export(t: Views):
    """Exported as CSV and read back."""
    review = exports.review_export(t.candidates, SITE)
    path = new_path(t.spark, "review-csv")
    files.write_csv(review, path)
    back = t.spark.read.option("header", True).option("escape", '"').schema(review.schema).csv(path)
    return back.fillna("")


MESSAGES = {
    "enhanced": "Dear {first_name},\n\nplease check {preview_url}. We used {enhanced_wc} words from\n{enhanced_url}.\n",
    "plain": "Dear {first_name},\n\nplease check {preview_url}. We read {manifesto_wc} words.\n",
}


@query(
    "message_table",
    f""", {REVIEW} SELECT trim(email) AS email, string_split(trim(full_name), ' ')[1] AS first_name, full_name,
          role, constituency, CASE WHEN enhanced_manifesto_found = 'yes' THEN 'enhanced' ELSE 'plain' END AS variant,
          'Your page' AS subject,
          'Dear ' || string_split(trim(full_name), ' ')[1] || ',' || chr(10) || chr(10) || 'please check ' || preview_url
          || CASE WHEN enhanced_manifesto_found = 'yes' THEN '. We used ' || enhanced_manifesto_word_count
               || ' words from' || chr(10) || enhanced_manifesto_url || '.' || chr(10)
             ELSE '. We read ' || manifesto_word_count || ' words.' || chr(10) END AS body
        FROM review WHERE trim(email) <> ''""",
    "candidates",
)
def message_table(t: Views):
    return exports.message_table(exports.review_export(t.candidates, SITE), MESSAGES, "Your page")


@query(
    "route_listing",
    f"""SELECT '{SITE}/' || lower(r_name) AS url, CAST(r_regionkey AS DOUBLE) / 10 AS priority,
          'weekly' AS change_frequency FROM region
        UNION ALL SELECT '{SITE}/candidates/' || slug, 0.9, 'daily' FROM candidates WHERE opted_out_at IS NULL
        UNION ALL SELECT '{SITE}/members/' || trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '-'),
          0.7, 'weekly' FROM members""",
    "candidates members",
)
def route_listing(t: Views):
    static = t.table("region").select(
        F.concat(F.lit("/"), F.lower("r_name")).alias("path"),
        (F.col("r_regionkey") / 10).alias("priority"),
        F.lit("weekly").alias("change_frequency"),
    )
    return reports.route_listing(t.members, t.candidates, static, SITE)


@query(
    "candidate_worklist",
    """SELECT candidate_id, full_name, coalesce(nullif(enhanced_manifesto_text, ''), manifesto_text) AS manifesto,
         coalesce(nullif(enhanced_manifesto_word_count, 0), manifesto_word_count) AS word_count
       FROM candidates WHERE (scrape_status IN ('ok', 'low_content') OR coalesce(enhanced_manifesto_text, '') <> '')
         AND (classified_at IS NULL OR enhanced_manifesto_fetched_at > classified_at)""",
    "candidates",
)
def candidate_worklist(t: Views):
    return annotate.candidate_worklist(t.candidates)


@query(
    "pending_sources",
    """SELECT candidate_id, full_name, role, constituency, party FROM candidates
       WHERE enhanced_manifesto_status IS NULL OR enhanced_manifesto_status = 'pending'""",
    "candidates",
)
def pending_sources(t: Views):
    return annotate.pending_sources(t.candidates).select(
        "candidate_id", "full_name", "role", "constituency", "party"
    )
