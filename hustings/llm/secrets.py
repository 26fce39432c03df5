"""Secrets in texts, judged by who else has them.

Candidates come from three patterns. Across the corpus the hash of every candidate's value
is counted by distinct owners and repositories: a value that several owners have is a copied
example, one that stays with few owners and looks random is taken for a live credential.
Both add spans of the value; the spans of the patterns stay. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hustings.llm.common import Scratch, table
from hustings.llm.registry import query


def either_case(word: str) -> str:
    """A pattern of the word's letters in either case, ASCII only, alike in all engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Names, marks and value characters of an assignment, and the lengths kept.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = (
    "(" + "|".join(either_case(n) for n in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "([0-9a-f]{32,})"  # a run that is long enough is found whole, and shorter ones are dropped anyway
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 1, 16), ("hex", HEX, 1, 32))
ORDER = ("assign", "access", "hex", "live", "example")
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your|xxxx|test"

LIVE_OWNERS = 2  # a value with more owners is a copied example
LIVE_LENGTH = 16


def found(text: Column, pattern: str, group: int) -> Column:
    """Matches as an array of (gap, size, value): characters before it, its own, and the group.

    Text that does not match is read once; else the pieces between the matches and the matches
    themselves are listed, which gives all positions without a search per match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"), values.alias("v")),
        lambda x: F.struct(
            F.char_length(x["g"]).cast("long").alias("gap"),
            F.char_length(x["m"]).cast("long").alias("size"),
            x["v"].alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), rows)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with an array of matches per kind (null where there is none)."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, *[found(F.col(text), p, g).alias(f"_{k}") for k, p, g, _ in KINDS])


def spans(rows: DataFrame, row: str = "rid") -> DataFrame:
    """(row, owner, repository, kind, start, end, value) of the matches that are long enough."""
    listed = None
    for kind, _, _, least in KINDS:
        one = rows.select(row, "owner", "repository", F.posexplode(f"_{kind}").alias("at", "m")).select(
            row, "owner", "repository", F.lit(kind).alias("kind"), "at", "m.gap", "m.size", "m.value",
            (F.char_length("m.value") >= least).alias("kept"),
        )
        listed = one if listed is None else listed.unionByName(one)
    upto = Window.partitionBy(row, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = listed.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return placed.where("kept").select(
        row, "owner", "repository", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value"
    )


def ownership(marked: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value.

    Rows shrink to distinct (hash, owner, repository) before their shuffle, so a value that a
    third of all documents have is a row per repository.
    """
    distinct = marked.select("hash", "owner", "repository").distinct()
    return distinct.groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )


def looks_live(value: str = "value") -> Column:
    """Long, with letters and digits, many different characters, and no placeholder word."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.char_length(value) >= LIVE_LENGTH)
        & F.col(value).rlike("[0-9]") & F.col(value).rlike("[A-Za-z]")
        & (kinds >= 8) & ~F.col(value).rlike(PLACEHOLDER)
    )


def scan(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    live_owners: int = LIVE_OWNERS,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts, digest of the base spans, all spans.

    `owner` and `repository` are expressions over `docs`; nulls count as one owner or
    repository. A null text is empty and has no spans; a null or repeated doc_id is a row like
    any other. Offsets are code points, ends exclusive. A value's span is live or an
    example; two patterns that find the same value at one place add it once.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    narrow = docs.select(
        "doc_id", F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), "text",
        F.monotonically_increasing_id().alias("rid"),
    )
    # Written once: the row numbers then stay, and the texts are read no more.
    rows = scratch.save(candidates(narrow), "candidates")
    marked = scratch.save(spans(rows).withColumn("hash", F.sha2("value", 256)), "spans")
    known = marked.join(ownership(marked), "hash")
    example = F.col("owners") > live_owners
    verdict = F.when(example, "example").when(looks_live(), "live")
    size = F.char_length("value")
    added = known.select("rid", verdict.alias("kind"), (F.col("end") - size).alias("start"), "end").where(
        "kind IS NOT NULL"
    ).distinct()
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    every = marked.select("rid", "kind", "start", "end").unionByName(added)
    text = F.concat_ws(":", "kind", "start", "end")
    base = F.col("kind").isin([k for k, *_ in KINDS])

    def joined(which: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(which, F.struct("start", rank.alias("rank"), "end", text.alias("text")))))
        return F.array_join(F.transform(listed, lambda x: x["text"]), ",")

    def count(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")

    by_row = every.groupBy("rid").agg(
        *[count(k) for k in ORDER], joined(base).alias("base"), joined(F.lit(True)).alias("spans")
    )
    merged = rows.select("doc_id", "rid").join(by_row, "rid", "left")
    return merged.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ORDER],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _kind_sql(kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, lang, '{kind}' AS kind, sum(len(g) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS "end", len(m) AS size, v AS value, len(v) >= {least} AS kept
  FROM (SELECT doc_id, source, lang, unnest(range(1, len(ms) + 1)) AS i, unnest(gs[1 : len(ms)]) AS g, unnest(ms) AS m, unnest(vs) AS v
    FROM (SELECT doc_id, source, lang, string_split_regex(text, '{quoted}') AS gs, regexp_extract_all(text, '{quoted}', 0) AS ms,
      regexp_extract_all(text, '{quoted}', {group}) AS vs FROM documents WHERE regexp_matches(text, '{quoted}')))"""


_RANK = "list_position([" + ", ".join(f"'{k}'" for k in ORDER) + "], kind)"
ORACLE = f"""
WITH listed AS ({" UNION ALL ".join(_kind_sql(*k) for k in KINDS)}
), marked AS (
  SELECT doc_id, source, lang, kind, "end" - size AS start, "end", value FROM listed WHERE kept
), owned AS (
  SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM marked GROUP BY value
), added AS (
  SELECT DISTINCT doc_id, kind, start, "end" FROM (
    SELECT doc_id, "end" - len(value) AS start, "end", CASE WHEN owners > {LIVE_OWNERS} THEN 'example'
      WHEN len(value) >= {LIVE_LENGTH} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        AND len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '{PLACEHOLDER}') THEN 'live' END AS kind
    FROM marked JOIN owned USING (value)) WHERE kind IS NOT NULL
), spans AS (
  SELECT *, {_RANK} AS rank, kind || ':' || start::BIGINT || ':' || "end"::BIGINT AS t
  FROM (SELECT doc_id, kind, start, "end" FROM marked UNION ALL SELECT doc_id, kind, start, "end" FROM added)
), by_doc AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ORDER)},
    string_agg(t, ',' ORDER BY start, rank, "end") FILTER (rank <= 3) AS base, string_agg(t, ',' ORDER BY start, rank, "end") AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ORDER)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM documents LEFT JOIN by_doc USING (doc_id)
"""


@query("op10_secrets", ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    # `documents` has no owners: the source stands for one, its part in one language for a repository.
    return scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))
