"""The driver tables as roll-call and candidate data, for Spark and for DuckDB.

`Views` gives each view as a DataFrame; `VIEWS` holds the same view as SQL text. Both
start from the raw tables and use them whole.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.operators import ingest
from hustings.session import stage

SINCE = "1995-04-01"
YEARS = [2000, 2001]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
POSITIONS = ["Mr.", "Mrs.", "Miss.", "Advocate", "Senators", "Connétable"]
ROLES = ["Deputy", "Connétable", "Senator"]
STAGE_WORDS = [
    "Draft Law: Principles",
    "Third Reading as amended",
    "Articles 3 to 5",
    "Amendment number 2",
    "Paragraph (a)",
    "Regulations 1 to 4",
    "Proposal to refer back",
    "Main proposal",
    "(Amd) as tabled",
]
STAGES = [
    "principles",
    "third_reading",
    "articles",
    "amendment",
    "paragraph",
    "regulations",
    "procedural",
    "other",
]
# Tables of texts. A test table is one file with one row group, which is one task whatever its size: a
# session that sets hustings.spread has their rows dealt out. Nothing is shuffled otherwise.
TEXTS = ("documents", "pages", "conversations")
LINE_ORDER = "l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice"


def pick(items: list, index) -> F.col:
    return F.element_at(F.array(*[F.lit(x) for x in items]), index.cast("int") + 1)


def sql_pick(items: list, index: str) -> str:
    quoted = ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)
    return f"[{quoted}][CAST({index} AS INTEGER) + 1]"


def text_of(column: str):
    return F.col(column).cast("string")


class Views:
    """Views over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A driver table."""
        if name not in self._tables:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            if name in TEXTS and self.spark.conf.get("hustings.spread", "false") == "true":
                df = df.repartition(self.spark.sparkContext.defaultParallelism)
            self._tables[name] = df
        return self._tables[name]

    # --- roll call ---

    @cached_property
    def lines(self) -> DataFrame:
        """lineitem with its row order and its vote text."""
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        away = ["Ill", "En défaut", "Not present for vote", "Unlisted"]
        vote = (
            F.when(flag == "R", "Pour")
            .when(flag == "A", "Contre")
            .when(status == "F", "Abstained")
            .otherwise(pick(away, F.col("l_linenumber") % 4))
        )
        order = F.struct(*LINE_ORDER.split(", ")).alias("row_no")
        return self.table("lineitem").select("*", order, vote.alias("vote"))

    @cached_property
    def votes_raw(self) -> DataFrame:
        return self.lines.select(
            F.col("l_partkey").alias("division_id"),
            F.col("l_suppkey").alias("member_id"),
            "vote",
            F.col("l_shipdate").alias("voted_at"),
            "row_no",
        )

    @cached_property
    def votes(self) -> DataFrame:
        return ingest.dedupe_votes(self.votes_raw)

    @cached_property
    def stored_votes(self) -> DataFrame:
        """The votes as a written table, for queries that read them more than once."""
        return stage(self.votes, "votes")

    @cached_property
    def rollcall(self) -> DataFrame:
        """The raw file: text columns with uneven spaces, old labels and bad dates."""
        part = F.col("l_partkey")
        base = F.concat(
            F.lit("P."),
            F.floor(part / 3).cast("string"),
            F.lit("/"),
            (F.lit(1995) + part % 7).cast("string"),
        )
        reference = (
            F.when(part % 6 == 0, base)
            .when(part % 6 == 1, F.concat(base, F.lit("(Amd)")))
            .when(part % 6 == 2, F.concat(base, F.lit("(Amd)("), (part % 4 + 2).cast("string"), F.lit(")")))
            .when(part % 6 == 3, F.concat(base, F.lit(" Re-issue")))
            .when(part % 6 == 4, F.concat(F.lit("{0A-B1}|"), base, F.lit(" ")))
            .otherwise(F.concat(F.lit("Statement "), (part % 40).cast("string")))
        )
        measure = F.concat(
            F.lit("Draft measure "),
            F.floor(part / 3).cast("string"),
            F.when(part % 11 == 0, " (lodged) principles")
            .when(part % 13 == 0, " - motion of closure")
            .otherwise(""),
            F.lit(" text "),
            (F.col("l_linenumber") % 2).cast("string"),
        )
        later = (F.year("l_shipdate") >= 1999).cast("int")
        return self.lines.select(
            text_of("l_partkey").alias("ID"),
            F.concat(
                F.lit("Supplier"),
                F.repeat(F.lit(" "), F.col("l_linenumber") % 3 + 1),
                F.lit("#"),
                F.lpad(text_of("l_suppkey"), 9, "0"),
            ).alias("MemberName"),
            pick(POSITIONS, (F.col("l_suppkey") + later) % 6).alias("MemberPosition"),
            F.when(F.col("l_tax") == 0.08, "unknown")
            .otherwise(F.date_format("l_shipdate", "dd/MM/yyyy HH:mm:ss"))
            .alias("Date"),
            F.when(part % 23 == 0, "").otherwise(reference).alias("Reference"),
            F.when(part % 17 == 0, "").otherwise(pick(STAGE_WORDS, part % 9)).alias("Title"),
            F.when(part % 19 == 0, "").otherwise(measure).alias("PropositionTitle"),
            F.when(F.col("l_quantity") % 9 == 0, "").otherwise(F.col("vote")).alias("Vote"),
            "row_no",
        )

    @cached_property
    def members(self) -> DataFrame:
        key = F.col("s_suppkey")
        history = F.array(
            F.struct(
                pick(["Deputy", "Senator", "Connétable"], F.col("s_nationkey") % 3).alias("position"),
                F.lit(9).cast("long").alias("count"),
            )
        )
        return self.table("supplier").select(
            key.alias("member_id"),
            F.col("s_name").alias("canonical_name"),
            F.col("s_name").alias("display_name"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 900).cast("int")).alias("first_vote_date"),
            F.date_add(F.lit("1998-01-01").cast("date"), (key % 900).cast("int")).alias("last_vote_date"),
            (F.col("s_acctbal") > 0).alias("is_currently_active"),
            F.when(F.col("s_nationkey") % 7 == 6, F.slice(history, 1, 0))
            .otherwise(history)
            .alias("position_history"),
        )

    @cached_property
    def props(self) -> DataFrame:
        size, brand = F.col("p_size"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        pid = (size * 1000 + brand).cast("long")
        grouped = (
            self.table("part")
            .groupBy("p_size", "p_brand")
            .agg(F.min("p_name").alias("title"), F.min("p_type").alias("topic"))
        )
        long_text = F.concat(
            F.lit("**What it proposed** "),
            F.col("title"),
            F.lit("\n\nBecause of "),
            F.col("topic"),
            F.lit("\n**Arguments**\nfor\n and against"),
        )
        return grouped.select(
            pid.alias("proposition_id"),
            F.concat(F.lit("P."), size.cast("string"), F.lit("/"), (brand + 2000).cast("string")).alias(
                "base_reference"
            ),
            (brand + 2000).alias("year"),
            size.alias("number"),
            F.concat(F.lit("https://example.org/p-"), pid.cast("string")).alias("source_url"),
            "title",
            F.when(size != 50, F.col("topic")).alias("topic_primary"),
            F.lit(None).cast("string").alias("topic_secondary"),
            F.array().cast("array<string>").alias("topic_tags"),
            F.when(size % 3 == 0, F.concat(F.lit("About "), F.col("title")))
            .when(size % 3 == 1, "")
            .alias("plain_language_summary"),
            F.when(size % 4 < 2, long_text).alias("extended_summary"),
            F.when(size % 5 != 0, F.repeat("title", 10)).alias("scraped_text"),
            pick(["pending", "ok", "not_found"], size % 3).alias("scrape_status"),
        )

    @cached_property
    def divisions(self) -> DataFrame:
        return self._divisions(self.votes)

    @cached_property
    def stored_divisions(self) -> DataFrame:
        """The divisions as a written table, tallied from the stored votes."""
        return stage(self._divisions(self.stored_votes), "divisions")

    def _divisions(self, votes: DataFrame) -> DataFrame:
        part = F.col("p_partkey")
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        dates = self.table("lineitem").groupBy(F.col("l_partkey").alias("division_id")).agg(
            F.min("l_shipdate").alias("date")
        )
        described = self.table("part").select(
            part.alias("division_id"),
            (F.col("p_size") * 1000 + brand).cast("long").alias("proposition_id"),
            F.col("p_type").alias("title"),
            F.concat("p_name", F.lit(" of "), "p_brand", F.lit(" in general terms, "), "p_type").alias(
                "proposition_title"
            ),
            F.concat(F.lit("P."), text_of("p_size"), F.lit("/"), (brand + 2000).cast("string")).alias(
                "reference"
            ),
            pick(STAGES, F.col("p_size") % 8).alias("division_stage"),
        )
        return described.join(dates, "division_id").join(
            ingest.division_tallies(votes), "division_id"
        )

    # --- candidates ---

    @cached_property
    def candidates(self) -> DataFrame:
        key = F.col("s_suppkey")
        found = key % 4 == 1
        stamp = F.lit("2026-03-01 00:00:00").cast("timestamp_ntz")
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.table("supplier")
            .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("candidate_id"),
                F.concat(F.lit("s-"), key.cast("string")).alias("slug"),
                F.col("s_name").alias("full_name"),
                pick(ROLES, key % 3).alias("role"),
                F.when(key % 3 != 2, F.col("n_name")).alias("constituency"),
                F.col("r_name").alias("party"),
                F.when(key % 5 != 0, F.concat(F.lit(" c"), key.cast("string"), F.lit("@example.org"))).alias(
                    "email"
                ),
                F.when(key % 9 != 0, F.concat(F.lit("tok"), key.cast("string"))).alias("correction_token"),
                F.when(key % 2 == 0, "reviewed").alias("correction_state"),
                F.when(key % 4 == 0, key).alias("incumbent_member_id"),
                F.lit(2026).alias("election_year"),
                F.when(F.col("s_acctbal") < 0, stamp).alias("opted_out_at"),
                F.when(key % 10 != 3, stamp).alias("classified_at"),
                pick(["ok", "low_content", "error"], key % 3).alias("scrape_status"),
                stamp.alias("scraped_at"),
                F.concat(F.lit("Text of "), "s_name").alias("manifesto_text"),
                F.when(key % 7 != 0, (key % 300).cast("int")).alias("manifesto_word_count"),
                F.when(found, "found").when(key % 4 == 2, "pending").alias("enhanced_manifesto_status"),
                F.when(found, F.concat(F.lit("Longer text of "), "s_name")).alias("enhanced_manifesto_text"),
                F.when(found, (key % 500 * 10).cast("int")).alias("enhanced_manifesto_word_count"),
                F.when(found, F.concat(F.lit("https://example.org/"), key.cast("string"))).alias(
                    "enhanced_manifesto_source_url"
                ),
                F.when(found & (key % 8 == 1), "party_page").alias("enhanced_manifesto_source_label"),
                F.lit(None).cast("string").alias("enhanced_manifesto_notes"),
                F.when(found, F.date_add(F.lit("2026-02-20").cast("date"), (key % 20).cast("int")))
                .cast("timestamp_ntz")
                .alias("enhanced_manifesto_fetched_at"),
            )
        )

    @cached_property
    def _typed_lines(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), "p_type", "p_name"
        )
        return self.table("lineitem").join(part, "l_partkey")

    @cached_property
    def candidate_topics(self) -> DataFrame:
        lines = self._typed_lines.groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"))
        totals = lines.groupBy("l_suppkey").agg(F.sum("n").alias("total"))
        return lines.join(totals, "l_suppkey").select(
            F.col("l_suppkey").alias("candidate_id"),
            F.col("p_type").alias("topic"),
            (F.floor(F.col("n") * 100 / F.col("total")) / 100.0).alias("salience"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        name = F.col("p_name")
        return self.table("part").select(name).distinct().select(
            name.alias("question_id"),
            pick(PART_TYPES, (F.ascii(name) + F.length(name)) % 6).alias("topic"),
            F.concat(F.lit("More of "), name).alias("statement"),
            F.length(name).alias("sort_order"),
        )

    @cached_property
    def stances(self) -> DataFrame:
        flag = F.col("l_returnflag")
        counted = self._typed_lines.groupBy("l_suppkey", "p_name").agg(
            F.count_if(flag == "R").alias("r"), F.count_if(flag == "A").alias("a")
        )
        return counted.select(
            F.col("l_suppkey").alias("candidate_id"),
            F.col("p_name").alias("question_id"),
            F.when(F.expr("r + a = 0"), "not_addressed")
            .when(F.expr("r > a"), "agree")
            .when(F.expr("r < a"), "disagree")
            .otherwise("neutral")
            .alias("stance"),
            F.when((F.col("l_suppkey") % 17 == 0) & (F.length("p_name") % 3 == 0), "neutral").alias(
                "corrected_stance"
            ),
        )

    @cached_property
    def _customer_lines(self) -> DataFrame:
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("respondent_id")
        )
        return self.lines.join(orders, "l_orderkey")

    @cached_property
    def answers(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        flag = F.col("l_returnflag")
        counted = self._customer_lines.join(part, "l_partkey").groupBy("respondent_id", "p_name").agg(
            F.count_if(flag == "R").alias("r"), F.count_if(flag == "A").alias("a")
        )
        return counted.select(
            "respondent_id",
            F.col("p_name").alias("question_id"),
            F.when(F.expr("r + a = 0"), "skip")
            .when(F.expr("r > a"), "agree")
            .when(F.expr("r < a"), "disagree")
            .otherwise("neutral")
            .alias("answer"),
        )

    @cached_property
    def priorities(self) -> DataFrame:
        """Every type a customer ordered, the most frequent first."""
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        counted = self._customer_lines.join(part, "l_partkey").groupBy("respondent_id", "p_type").agg(
            F.count("*").alias("n")
        )
        position = F.struct((-F.col("n")).alias("n"), "p_type")
        return counted.select("respondent_id", position.alias("position"), F.col("p_type").alias("topic"))

    @cached_property
    def division_answers(self) -> DataFrame:
        given = self._customer_lines.where(F.col("vote").isin("Pour", "Contre"))
        return given.groupBy("respondent_id", F.col("l_partkey").alias("division_id")).agg(
            F.max_by(F.when(F.col("vote") == "Pour", "pour").otherwise("contre"), "row_no").alias("vote")
        )

    # --- people and documents ---

    @cached_property
    def _named_documents(self) -> DataFrame:
        name = F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1)
        return self.table("documents").select("doc_id", "source", name.alias("name"))

    def stored_names(self) -> "Views":
        """These views with the names as a written table, for queries that read people more than once."""
        views = Views(self.spark, self.dir)
        views._named_documents = stage(self._named_documents, "names")
        return views

    @cached_property
    def person_members(self) -> DataFrame:
        """Labelled documents of good quality stand for active members."""
        good = self.table("labels").where("quality = 1").select("doc_id")
        return self._named_documents.join(good, "doc_id", "left_semi").select(
            F.col("doc_id").alias("member_id"), "name"
        )

    @cached_property
    def person_candidates(self) -> DataFrame:
        """All other documents stand for candidates."""
        good = self.table("labels").where("quality = 1").select("doc_id")
        return self._named_documents.join(good, "doc_id", "left_anti").select(
            F.col("doc_id").alias("candidate_id"),
            F.concat(F.lit("doc-"), text_of("doc_id")).alias("slug"),
            "name",
            "source",
        )

    @cached_property
    def person_overrides(self) -> DataFrame:
        """Candidates of one source, forced to the first member's name."""
        first = self.person_members.agg(F.min_by("name", "member_id")).scalar()
        return self.person_candidates.where("source = 'src3'").select(
            "slug", first.alias("member_name"), F.col("candidate_id").alias("row_no")
        )


LINE_VOTE = """CASE WHEN l_returnflag = 'R' THEN 'Pour' WHEN l_returnflag = 'A' THEN 'Contre'
      WHEN l_linestatus = 'F' THEN 'Abstained'
      ELSE ['Ill', 'En défaut', 'Not present for vote', 'Unlisted'][l_linenumber % 4 + 1] END"""
BRAND = "CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)"

# Each view as SQL; views it uses come first.
VIEWS: dict[str, tuple[list[str], str]] = {
    "lines": (
        [],
        f"""SELECT *, {LINE_VOTE} AS vote,
          row_number() OVER (ORDER BY {LINE_ORDER}) AS row_no FROM lineitem""",
    ),
    "votes_raw": (
        ["lines"],
        """SELECT l_partkey AS division_id, l_suppkey AS member_id, vote,
          l_shipdate AS voted_at, row_no FROM lines""",
    ),
    "votes": (
        ["votes_raw"],
        """SELECT division_id, member_id, vote,
          CASE WHEN vote IN ('Pour', 'Contre', 'Abstained') THEN 'active_vote'
               WHEN vote IN ('Ill', 'Out of the Island', 'Excused attendance', 'Parental responsibilities',
                             'Declared an interest', 'Suspended', 'Presiding') THEN 'excused_absence'
               WHEN vote IN ('Not present for vote', 'En défaut') THEN 'unexcused_absence'
               ELSE 'unknown' END AS vote_category
        FROM votes_raw
        QUALIFY row_number() OVER (PARTITION BY division_id, member_id
          ORDER BY CASE WHEN vote IN ('Pour', 'Contre', 'Abstained') THEN 0 ELSE 1 END, row_no) = 1""",
    ),
    "rollcall": (
        ["lines"],
        f"""SELECT CAST(l_partkey AS VARCHAR) AS ID,
          'Supplier' || repeat(' ', CAST(l_linenumber % 3 + 1 AS BIGINT)) || '#'
            || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS MemberName,
          {sql_pick(POSITIONS, "(l_suppkey + CASE WHEN year(l_shipdate) >= 1999 THEN 1 ELSE 0 END) % 6")}
            AS MemberPosition,
          CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN 'unknown'
               ELSE strftime(l_shipdate, '%d/%m/%Y %H:%M:%S') END AS "Date",
          CASE WHEN l_partkey % 23 = 0 THEN '' ELSE CASE l_partkey % 6
            WHEN 0 THEN base WHEN 1 THEN base || '(Amd)'
            WHEN 2 THEN base || '(Amd)(' || (l_partkey % 4 + 2) || ')'
            WHEN 3 THEN base || ' Re-issue' WHEN 4 THEN '{{0A-B1}}|' || base || ' '
            ELSE 'Statement ' || (l_partkey % 40) END END AS Reference,
          CASE WHEN l_partkey % 17 = 0 THEN '' ELSE {sql_pick(STAGE_WORDS, "l_partkey % 9")} END AS Title,
          CASE WHEN l_partkey % 19 = 0 THEN '' ELSE 'Draft measure ' || (l_partkey // 3)
            || CASE WHEN l_partkey % 11 = 0 THEN ' (lodged) principles'
                    WHEN l_partkey % 13 = 0 THEN ' - motion of closure' ELSE '' END
            || ' text ' || (l_linenumber % 2) END AS PropositionTitle,
          CASE WHEN l_quantity % 9 = 0 THEN '' ELSE vote END AS Vote, row_no
        FROM (SELECT *, 'P.' || (l_partkey // 3) || '/' || (1995 + l_partkey % 7) AS base FROM lines)""",
    ),
    "members": (
        [],
        """SELECT s_suppkey AS member_id, s_name AS canonical_name, s_name AS display_name,
          DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS first_vote_date,
          DATE '1998-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS last_vote_date,
          s_acctbal > 0 AS is_currently_active,
          CASE WHEN s_nationkey % 7 = 6 THEN 'Member'
               ELSE ['Deputy', 'Senator', 'Connétable'][s_nationkey % 3 + 1] END AS main_position
        FROM supplier""",
    ),
    "props": (
        [],
        f"""SELECT CAST(p_size * 1000 + brand AS BIGINT) AS proposition_id,
          'P.' || p_size || '/' || (brand + 2000) AS base_reference,
          brand + 2000 AS year, p_size AS number,
          'https://example.org/p-' || (p_size * 1000 + brand) AS source_url,
          title, CASE WHEN p_size <> 50 THEN topic END AS topic_primary,
          CASE p_size % 3 WHEN 0 THEN 'About ' || title WHEN 1 THEN '' END AS plain_language_summary,
          CASE WHEN p_size % 4 < 2 THEN '**What it proposed** ' || title || chr(10) || chr(10)
            || 'Because of ' || topic || chr(10) || '**Arguments**' || chr(10) || 'for' || chr(10)
            || ' and against' END AS extended_summary,
          CASE WHEN p_size % 5 <> 0 THEN repeat(title, 10) END AS scraped_text,
          ['pending', 'ok', 'not_found'][p_size % 3 + 1] AS scrape_status
        FROM (SELECT p_size, {BRAND} AS brand, min(p_name) AS title, min(p_type) AS topic
              FROM part GROUP BY ALL)""",
    ),
    "tallies": (
        ["votes"],
        """SELECT division_id, count(*) FILTER (vote = 'Pour') AS pour_count,
          count(*) FILTER (vote = 'Contre') AS contre_count,
          count(*) FILTER (vote = 'Abstained') AS abstain_count,
          count(*) FILTER (vote NOT IN ('Pour', 'Contre', 'Abstained')) AS absent_count,
          count(*) AS total_eligible FROM votes GROUP BY division_id""",
    ),
    "divisions": (
        ["tallies"],
        f"""SELECT p_partkey AS division_id,
          CAST(p_size * 1000 + {BRAND} AS BIGINT) AS proposition_id, p_type AS title,
          p_name || ' of ' || p_brand || ' in general terms, ' || p_type AS proposition_title,
          'P.' || p_size || '/' || ({BRAND} + 2000) AS reference,
          {sql_pick(STAGES, "p_size % 8")} AS division_stage, d.date, t.* EXCLUDE (division_id)
        FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS date FROM lineitem GROUP BY 1) d
          ON d.l_partkey = p_partkey JOIN tallies t ON t.division_id = p_partkey""",
    ),
    "candidates": (
        [],
        f"""SELECT s_suppkey AS candidate_id, 's-' || s_suppkey AS slug, s_name AS full_name,
          {sql_pick(ROLES, "s_suppkey % 3")} AS role,
          CASE WHEN s_suppkey % 3 <> 2 THEN n_name END AS constituency, r_name AS party,
          CASE WHEN s_suppkey % 5 <> 0 THEN ' c' || s_suppkey || '@example.org' END AS email,
          CASE WHEN s_suppkey % 9 <> 0 THEN 'tok' || s_suppkey END AS correction_token,
          CASE WHEN s_suppkey % 2 = 0 THEN 'reviewed' END AS correction_state,
          CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS incumbent_member_id,
          2026 AS election_year,
          CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2026-03-01' END AS opted_out_at,
          CASE WHEN s_suppkey % 10 <> 3 THEN TIMESTAMP '2026-03-01' END AS classified_at,
          ['ok', 'low_content', 'error'][s_suppkey % 3 + 1] AS scrape_status,
          TIMESTAMP '2026-03-01' AS scraped_at, 'Text of ' || s_name AS manifesto_text,
          CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 300 AS INTEGER) END AS manifesto_word_count,
          CASE s_suppkey % 4 WHEN 1 THEN 'found' WHEN 2 THEN 'pending' END AS enhanced_manifesto_status,
          CASE WHEN s_suppkey % 4 = 1 THEN 'Longer text of ' || s_name END AS enhanced_manifesto_text,
          CASE WHEN s_suppkey % 4 = 1 THEN CAST(s_suppkey % 500 * 10 AS INTEGER) END
            AS enhanced_manifesto_word_count,
          CASE WHEN s_suppkey % 4 = 1 THEN 'https://example.org/' || s_suppkey END
            AS enhanced_manifesto_source_url,
          CASE WHEN s_suppkey % 8 = 1 THEN 'party_page' END AS enhanced_manifesto_source_label,
          CASE WHEN s_suppkey % 4 = 1
            THEN CAST(DATE '2026-02-20' + CAST(s_suppkey % 20 AS INTEGER) AS TIMESTAMP) END
            AS enhanced_manifesto_fetched_at
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    ),
    "candidate_topics": (
        [],
        """SELECT l_suppkey AS candidate_id, p_type AS topic,
          floor(count(*) * 100 / sum(count(*)) OVER (PARTITION BY l_suppkey)) / CAST(100 AS DOUBLE) AS salience
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type""",
    ),
    "questions": (
        [],
        f"""SELECT p_name AS question_id,
          {sql_pick(PART_TYPES, "(ascii(p_name) + length(p_name)) % 6")} AS topic,
          'More of ' || p_name AS statement, length(p_name) AS sort_order
        FROM (SELECT DISTINCT p_name FROM part)""",
    ),
    "stances": (
        [],
        """SELECT l_suppkey AS candidate_id, p_name AS question_id,
          CASE WHEN r + a = 0 THEN 'not_addressed' WHEN r > a THEN 'agree' WHEN r < a THEN 'disagree'
               ELSE 'neutral' END AS stance,
          CASE WHEN l_suppkey % 17 = 0 AND length(p_name) % 3 = 0 THEN 'neutral' END AS corrected_stance
        FROM (SELECT l_suppkey, p_name, count(*) FILTER (l_returnflag = 'R') AS r,
                count(*) FILTER (l_returnflag = 'A') AS a
              FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)""",
    ),
    "customer_lines": (
        ["lines"],
        """SELECT l.*, o_custkey AS respondent_id FROM lines l JOIN orders ON o_orderkey = l_orderkey""",
    ),
    "answers": (
        ["customer_lines"],
        """SELECT respondent_id, p_name AS question_id,
          CASE WHEN r + a = 0 THEN 'skip' WHEN r > a THEN 'agree' WHEN r < a THEN 'disagree'
               ELSE 'neutral' END AS answer
        FROM (SELECT respondent_id, p_name, count(*) FILTER (l_returnflag = 'R') AS r,
                count(*) FILTER (l_returnflag = 'A') AS a
              FROM customer_lines JOIN part ON p_partkey = l_partkey GROUP BY ALL)""",
    ),
    "priorities": (
        ["customer_lines"],
        """SELECT respondent_id, p_type AS topic,
          row_number() OVER (PARTITION BY respondent_id ORDER BY count(*) DESC, p_type) AS place
        FROM customer_lines JOIN part ON p_partkey = l_partkey GROUP BY respondent_id, p_type
        QUALIFY place <= 5""",
    ),
    "division_answers": (
        ["customer_lines"],
        """SELECT respondent_id, l_partkey AS division_id, lower(vote) AS vote FROM customer_lines
        WHERE vote IN ('Pour', 'Contre')
        QUALIFY row_number() OVER (PARTITION BY respondent_id, l_partkey ORDER BY row_no DESC) = 1""",
    ),
    "named_documents": (
        [],
        r"""SELECT doc_id, source, name,
          lower(trim(regexp_replace(regexp_replace(strip_accents(name), '[^A-Za-z0-9\s]', ' ', 'g'),
            '\s+', ' ', 'g'))) AS canon
        FROM (SELECT doc_id, source, regexp_extract(text, '^\s*(\S+\s+\S+)', 1) AS name FROM documents)""",
    ),
    "people": (
        ["named_documents"],
        """SELECT d.*, CASE WHEN instr(canon, ' ') > 0
            THEN canon[1] || ' ' || string_split(canon, ' ')[-1] END AS key,
          CASE WHEN l.quality = 1 THEN 'member' ELSE 'candidate' END AS kind
        FROM named_documents d LEFT JOIN labels l USING (doc_id)""",
    ),
}


def with_views(query: str, *names: str) -> str:
    """A query over views, as one statement that starts at the raw tables."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return query
    # `lines` feeds several views and holds a window; keep its result.
    text = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered)
    # A recursive query says itself where the views go.
    return "WITH " + query.replace("{views}", text) if "{views}" in query else f"WITH {text}\n{query}"
