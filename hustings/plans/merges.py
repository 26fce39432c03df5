"""Queries that compute the next version of a maintained table."""

from pyspark.sql import functions as F

from hustings.operators import merge, pages
from hustings.functions.text import word_count
from hustings.functions.rules import topic_rules
from hustings.plans.fixtures import Views
from hustings.plans.registry import query
from hustings.plans.texts import WORK_RULES


def latest_events(t: Views):
    """The latest event of every user: a batch of profile updates."""
    return (
        t.table("events")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(F.max_by(F.struct("event_type", "value", "props", "ts"), F.struct("ts", "event_id")).alias("e"))
        .select("c_custkey", "e.*")
    )


LATEST = """latest AS (SELECT * FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


def profile_events(t: Views):
    """Every event as a profile update, many per key; some keys are not stored yet."""
    kind = F.col("event_type")
    return t.table("events").select(
        (F.col("user_id") * 13).alias("c_custkey"),
        kind.alias("full_name"),
        F.when(kind != "click", kind).alias("role"),
        F.when(kind == "view", F.col("props")).alias("party"),
        F.col("value").alias("balance"),
        F.date_add(F.lit("2026-02-02").cast("date"), (F.col("event_id") % 5).cast("int")).alias("opted_out_at"),
        F.struct("ts", "event_id").alias("at"),
    )


def stored_profiles(t: Views):
    return t.table("customer").select(
        "c_custkey",
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("role"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("party"),
        F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") < 0, F.lit("2026-01-01").cast("date")).alias("opted_out_at"),
    )


STORED = """stored AS (SELECT c_custkey, c_name AS full_name, c_mktsegment AS role,
    CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS party, c_acctbal AS balance,
    CASE WHEN c_acctbal < 0 THEN DATE '2026-01-01' END AS opted_out_at FROM customer)"""


@query(
    "upsert_profiles",
    f"""WITH {STORED}, given AS (SELECT user_id * 13 AS c_custkey, event_type,
          CASE WHEN event_type <> 'click' THEN event_type END AS role, CASE WHEN event_type = 'view' THEN props END AS party,
          value, DATE '2026-02-02' + CAST(event_id % 5 AS INTEGER) AS opted_out_at, row_number() OVER (ORDER BY ts, event_id) AS ord
          FROM events),
        batch AS (SELECT c_custkey, arg_max(event_type, ord) AS full_name, arg_max(role, ord) FILTER (role IS NOT NULL) AS role,
          arg_max(party, ord) FILTER (party IS NOT NULL) AS party, arg_max(value, ord) AS balance,
          arg_min(opted_out_at, ord) AS opted_out_at FROM given GROUP BY c_custkey)
        SELECT c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN b.full_name ELSE s.full_name END AS full_name,
          coalesce(b.role, s.role) AS role, coalesce(b.party, s.party) AS party,
          coalesce(b.balance, s.balance) AS balance,
          CASE WHEN s.full_name IS NULL THEN b.opted_out_at ELSE s.opted_out_at END AS opted_out_at
        FROM stored s FULL JOIN batch b USING (c_custkey)""",
)
def upsert_profiles(t: Views):
    return merge.upsert(stored_profiles(t), profile_events(t), ["c_custkey"], merge.PROFILE_POLICY, order="at")


@query(
    "upsert_questions",
    """SELECT question_id, topic, CASE WHEN topic = 'PROMO' THEN 'New: ' || statement ELSE statement END AS statement,
         sort_order FROM questions
       UNION ALL SELECT 'q' || item_id, 'PROMO', text, CAST(item_id AS INTEGER) FROM benchmark""",
    "questions",
)
def upsert_questions(t: Views):
    revised = t.questions.where("topic = 'PROMO'").withColumn(
        "statement", F.concat(F.lit("New: "), "statement")
    )
    added = t.table("benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"),
        F.lit("PROMO").alias("topic"),
        F.col("text").alias("statement"),
        F.col("item_id").cast("int").alias("sort_order"),
    )
    return merge.upsert(t.questions, revised.unionByName(added), ["question_id"])


@query(
    "replace_children",
    """, fresh AS (SELECT s_suppkey AS candidate_id, r_name AS topic, CAST(0.5 AS DOUBLE) AS salience
           FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
           WHERE r_name <> 'ASIA')
       SELECT * FROM candidate_topics WHERE candidate_id NOT IN (SELECT candidate_id FROM fresh)
       UNION ALL SELECT * FROM fresh""",
    "candidate_topics",
)
def replace_children(t: Views):
    fresh = t.candidates.where("party <> 'ASIA'").select(
        "candidate_id", F.col("party").alias("topic"), F.lit(0.5).alias("salience")
    )
    return merge.replace_children(t.candidate_topics, fresh, "candidate_id")


@query(
    "update_source",
    f"""WITH {LATEST} SELECT c_custkey, c_name, CASE WHEN user_id IS NULL THEN 'pending'
          WHEN event_type IN ('view', 'click') THEN 'found' ELSE 'not_found' END AS status,
          CASE WHEN user_id IS NOT NULL THEN CASE WHEN event_type = 'view' THEN props END END AS text,
          CASE WHEN user_id IS NOT NULL THEN CASE WHEN event_type = 'view' THEN 2 END END AS word_count,
          CASE WHEN user_id IS NOT NULL THEN 'https://example.org/' || user_id END AS source_url,
          CASE WHEN user_id IS NULL THEN c_mktsegment END AS source_label,
          CASE WHEN user_id IS NOT NULL THEN event_type END AS notes,
          CASE WHEN event_type IN ('view', 'click') THEN DATE '2026-04-01' ELSE DATE '2026-01-01' END AS fetched_at
        FROM customer LEFT JOIN latest ON user_id = c_custkey""",
)
def update_source(t: Views):
    kind = F.col("event_type")
    none = F.lit(None).cast("string")
    old = t.table("customer").select(
        "c_custkey",
        "c_name",
        F.lit("pending").alias("status"),
        none.alias("text"),
        none.cast("int").alias("word_count"),
        none.alias("source_url"),
        F.col("c_mktsegment").alias("source_label"),
        none.alias("notes"),
        F.lit("2026-01-01").cast("date").alias("fetched_at"),
    )
    updates = latest_events(t).select(
        "c_custkey",
        F.when(kind.isin("view", "click"), "found").otherwise("not_found").alias("status"),
        F.when(kind == "view", F.col("props")).alias("text"),
        F.when(kind == "view", F.lit(2)).alias("word_count"),
        F.concat(F.lit("https://example.org/"), F.col("c_custkey").cast("string")).alias("source_url"),
        none.alias("source_label"),
        kind.alias("notes"),
    )
    return merge.update_source(old, updates, "c_custkey", F.lit("2026-04-01").cast("date"))


@query(
    "update_candidate_source",
    """, found AS (SELECT user_id AS candidate_id, event_id, ts, event_type, props FROM events),
         outcome AS (SELECT candidate_id, arg_max(event_id, (ts, event_id)) AS event_id,
           bool_or(event_type IN ('view', 'click')) AS any_found FROM found GROUP BY candidate_id),
         last AS (SELECT o.candidate_id, o.any_found, e.event_id, e.event_type, e.props FROM outcome o JOIN events e USING (event_id))
       SELECT candidate_id, CASE WHEN event_id IS NULL THEN enhanced_manifesto_status
           WHEN event_type IN ('view', 'click') THEN 'found' ELSE 'not_found' END AS status,
         CASE WHEN event_id IS NULL THEN enhanced_manifesto_text ELSE props END AS text,
         CASE WHEN event_id IS NULL THEN enhanced_manifesto_word_count ELSE CAST(event_id % 100 AS INTEGER) END AS word_count,
         CASE WHEN event_id IS NULL THEN enhanced_manifesto_source_label ELSE event_type END AS label,
         CASE WHEN any_found THEN DATE '2026-04-01' ELSE CAST(enhanced_manifesto_fetched_at AS DATE) END AS fetched
       FROM candidates LEFT JOIN last USING (candidate_id)""",
    "candidates",
)
def update_candidate_source(t: Views):
    """Every event as the outcome of a search for a candidate's text, the last one wins."""
    kind = F.col("event_type")
    updates = t.table("events").select(
        F.col("user_id").alias("candidate_id"),
        F.when(kind.isin("view", "click"), "found").otherwise("not_found").alias("status"),
        F.col("props").alias("text"),
        (F.col("event_id") % 100).cast("int").alias("word_count"),
        F.lit("https://example.org/").alias("source_url"),
        kind.alias("source_label"),
        F.lit(None).cast("string").alias("notes"),
        F.struct("ts", "event_id").alias("at"),
    )
    now = F.lit("2026-04-01 00:00:00").cast("timestamp_ntz")
    stored = merge.update_source(t.candidates, updates, "candidate_id", now, merge.CANDIDATE_SOURCE, order="at")
    return stored.select(
        "candidate_id",
        F.col("enhanced_manifesto_status").alias("status"),
        F.col("enhanced_manifesto_text").alias("text"),
        F.col("enhanced_manifesto_word_count").alias("word_count"),
        F.col("enhanced_manifesto_source_label").alias("label"),
        F.to_date("enhanced_manifesto_fetched_at").alias("fetched"),
    )


@query(
    "mark_classified",
    """SELECT candidate_id, CASE WHEN candidate_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')
         THEN DATE '2026-06-06' ELSE CAST(classified_at AS DATE) END AS classified FROM candidates""",
    "candidates",
)
def mark_classified(t: Views):
    finished = t.table("events").where("event_type = 'purchase'").select(F.col("user_id").alias("candidate_id"))
    now = F.lit("2026-06-06 00:00:00").cast("timestamp_ntz")
    stamped = merge.mark_classified(t.candidates, finished, "candidate_id", now)
    return stamped.select("candidate_id", F.to_date("classified_at").alias("classified"))


@query(
    "apply_topics",
    r""", ruled AS (SELECT proposition_id, CASE
            WHEN (regexp_matches(lower(title), '\banvil\b') OR regexp_matches(lower(title), '\bred\b.*\bring\b'))
              AND NOT regexp_matches(lower(title), '\bgreen\b') THEN 'STANDARD'
            WHEN regexp_matches(lower(title), 'gear\b') THEN 'SMALL' END AS topic FROM props)
       SELECT proposition_id, title, coalesce(topic, CASE WHEN year % 2 = 0 THEN 'PROMO' ELSE 'ECONOMY' END) AS topic_primary,
         CASE WHEN topic IS NULL THEN 'LARGE' END AS topic_secondary,
         CASE WHEN topic IS NULL THEN 'reply|tag' ELSE 'rule' END AS topic_tags,
         CASE WHEN topic IS NULL THEN 'Replied ' || title ELSE 'Ruled ' || title END AS plain_language_summary
       FROM props JOIN ruled USING (proposition_id)""",
    "props",
)
def apply_topics(t: Views):
    """Rule labels and reply labels written to the propositions."""
    routed = t.props.withColumn("topic", topic_rules(F.col("title"), WORK_RULES))
    keyword = routed.where("topic IS NOT NULL").select(
        "proposition_id",
        "topic",
        F.array(F.lit("rule")).alias("tags"),
        F.concat(F.lit("Ruled "), "title").alias("summary"),
    )
    replied = routed.where("topic IS NULL").select(
        "proposition_id",
        F.when(F.col("year") % 2 == 0, "PROMO").otherwise("ECONOMY").alias("primary"),
        F.lit("LARGE").alias("secondary"),
        F.array(F.lit("reply"), F.lit("tag")).alias("tags"),
        F.concat(F.lit("Replied "), "title").alias("summary"),
    )
    return merge.apply_topics(t.props, keyword, replied).select(
        "proposition_id",
        "title",
        "topic_primary",
        "topic_secondary",
        F.array_join("topic_tags", "|").alias("topic_tags"),
        "plain_language_summary",
    )


@query(
    "soft_delete",
    """SELECT candidate_id, correction_token, CASE WHEN opted_out_at IS NOT NULL THEN CAST(opted_out_at AS DATE)
         WHEN correction_token IN (SELECT 'tok' || user_id FROM events WHERE event_type = 'error')
         THEN DATE '2026-05-05' END AS opted_out_at FROM candidates""",
    "candidates",
)
def soft_delete(t: Views):
    """Error events stand for opt-out requests; a token may be sent many times."""
    requests = t.table("events").where("event_type = 'error'").select(
        F.concat(F.lit("tok"), F.col("user_id").cast("string")).alias("correction_token")
    )
    now = F.lit("2026-05-05 00:00:00").cast("timestamp_ntz")
    return merge.soft_delete(t.candidates, requests, now).select(
        "candidate_id", "correction_token", F.to_date("opted_out_at").alias("opted_out_at")
    )


@query(
    "party_document",
    r""", parts AS (SELECT ['AFRICA', 'AMERICA', 'ASIA'][CAST(conv_id % 3 + 1 AS INTEGER)] AS party, conv_id * 1000 + turn AS ord,
            regexp_replace(text, '^\s+|\s+$', '', 'g') AS part FROM conversations),
         docs AS (SELECT lower(party) AS party, string_agg('## ' || (ord // 1000) || chr(10) || chr(10) || part,
            chr(10) || chr(10) ORDER BY ord)[1:200000] AS text FROM parts GROUP BY 1)
       SELECT candidate_id, c.party, CASE WHEN d.party IS NOT NULL THEN 'found' ELSE enhanced_manifesto_status END AS status,
         CASE WHEN d.party IS NOT NULL THEN md5(d.text) ELSE md5(enhanced_manifesto_text) END AS digest,
         CASE WHEN d.party IS NOT NULL THEN CAST(len(list_filter(string_split_regex(d.text, '\s+'), lambda w: w <> '')) AS INTEGER)
           ELSE enhanced_manifesto_word_count END AS word_count,
         CASE WHEN d.party IS NOT NULL THEN 'party_manifesto' ELSE enhanced_manifesto_source_label END AS label
       FROM candidates c LEFT JOIN docs d ON d.party = lower(c.party)""",
    "candidates",
)
def party_document(t: Views):
    """Conversations joined to one document a party, given to the party's candidates."""
    parties = F.array(F.lit("AFRICA"), F.lit("AMERICA"), F.lit("ASIA"))
    parts = t.table("conversations").select(
        F.element_at(parties, (F.col("conv_id") % 3 + 1).cast("int")).alias("party"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        pages.chapter_text(F.col("conv_id").cast("string"), F.col("text")).alias("part"),
    )
    documents = pages.assemble_document(parts, "party", "ord").select(
        "party",
        F.col("document").alias("text"),
        word_count(F.col("document")).alias("word_count"),
        F.lit("https://example.org/manifesto").alias("source_url"),
        F.concat(F.lit("Joined "), F.col("parts").cast("string"), F.lit(" parts")).alias("notes"),
    )
    now = F.lit("2026-04-01 00:00:00").cast("timestamp_ntz")
    given = merge.party_document(t.candidates, documents, now)
    return given.select(
        "candidate_id",
        "party",
        F.col("enhanced_manifesto_status").alias("status"),
        F.md5(F.col("enhanced_manifesto_text").cast("binary")).alias("digest"),
        F.col("enhanced_manifesto_word_count").alias("word_count"),
        F.col("enhanced_manifesto_source_label").alias("label"),
    )
