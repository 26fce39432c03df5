"""Queries that link people by name."""

from pyspark.sql import functions as F

from hustings.functions import text
from hustings.operators import linkage
from hustings.plans.fixtures import Views
from hustings.plans.registry import query


@query("canonical_name", "SELECT doc_id, name, canon AS canonical_name, key AS initial_key FROM people", "people")
def canonical_name(t: Views):
    canon = text.canonical_name(F.col("name"))
    return t._named_documents.select("doc_id", "name", canon.alias("canonical_name")).withColumn(
        "initial_key", text.initial_key(F.col("canonical_name"))
    )


@query(
    "slug",
    """SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'),
         '^-|-$', '', 'g') AS slug FROM people""",
    "people",
)
def slug(t: Views):
    return t._named_documents.select("doc_id", text.slug(F.col("name")).alias("slug"))


LINKS = """cand AS (SELECT * FROM people WHERE kind = 'candidate'),
  seats AS (SELECT * FROM people WHERE kind = 'member'),
  by_name AS (SELECT canon, max(doc_id) AS member_id FROM seats GROUP BY canon),
  sole AS (SELECT s.key, max(s.doc_id) AS member_id FROM seats s WHERE key IS NOT NULL
    AND key IN (SELECT key FROM cand GROUP BY key HAVING count(*) = 1) GROUP BY s.key HAVING count(*) = 1),
  forced AS (SELECT member_id FROM by_name WHERE canon = (SELECT arg_min(canon, doc_id) FROM seats)),
  links AS (SELECT c.doc_id AS candidate_id, c.name,
    coalesce(CASE WHEN c.source = 'src3' THEN (SELECT member_id FROM forced) END, b.member_id, s.member_id) AS member_id,
    CASE WHEN c.source = 'src3' THEN 'override' WHEN b.member_id IS NOT NULL THEN 'exact'
         WHEN s.member_id IS NOT NULL THEN 'initial-unique' END AS reason
    FROM cand c LEFT JOIN by_name b ON b.canon = c.canon LEFT JOIN sole s ON s.key = c.key)"""


def links(t: Views):
    return linkage.link_people(t.person_candidates, t.person_members, t.person_overrides)


@query(
    "link_people",
    f", {LINKS} SELECT candidate_id, member_id, reason FROM links WHERE member_id IS NOT NULL",
    "people",
)
def link_people(t: Views):
    return links(t)


@query(
    "apply_links",
    f""", {LINKS} SELECT candidate_id, name, member_id AS incumbent_member_id FROM links""",
    "people",
)
def apply_links(t: Views):
    """Links written to the candidates after clearing the earlier ones."""
    old = t.person_candidates.select(
        "candidate_id", "name", F.col("candidate_id").alias("incumbent_member_id")
    )
    return linkage.apply_links(old, links(t), clear=True)


@query("near_misses")
def near_misses(t: Views):
    t = t.stored_names()
    return linkage.near_misses(t.person_candidates, t.person_members, links(t))


@query(
    "near_miss_pairs",
    f""", {LINKS} SELECT a, b FROM (SELECT DISTINCT canon AS a FROM cand WHERE canon <> '' AND doc_id NOT IN
          (SELECT candidate_id FROM links WHERE member_id IS NOT NULL)) x
        JOIN (SELECT DISTINCT canon AS b FROM seats WHERE canon <> '') y
          ON levenshtein(a, b) <= CAST(0.15 AS DOUBLE) * (length(a) + length(b)) + 1e-9
        WHERE list_sum([least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, '')))
            FOR c IN list_distinct(string_split(a, ''))]) >= CAST(0.85 AS DOUBLE) * (length(a) + length(b)) / 2 - 1e-9""",
    "people",
)
def near_miss_pairs(t: Views):
    """The pairs of names that `near_misses` works the ratio out for."""
    t = t.stored_names()
    own = t.person_candidates.join(links(t), "candidate_id", "left_anti")
    return linkage.near_pairs(
        own.select(text.canonical_name(F.col("name")).alias("a")),
        t.person_members.select(text.canonical_name(F.col("name")).alias("b")),
    )


@query(
    "link_collisions",
    """, keys AS (SELECT key, count(*) FILTER (kind = 'candidate') AS n_candidates,
            count(*) FILTER (kind = 'member') AS n_members FROM people WHERE key IS NOT NULL GROUP BY key)
       SELECT key, n_candidates, n_members, kind, doc_id AS person_id, name FROM people JOIN keys USING (key)
       WHERE n_candidates > 1 AND n_members >= 1 AND kind IS NOT NULL""",
    "people",
)
def link_collisions(t: Views):
    return linkage.link_collisions(t.person_candidates, t.person_members)
