"""Model replies as a table: parsing, cleaning, alignment, and the lists of open work."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hustings import vocab
from hustings.functions.rules import Rule, topic_rules
from hustings.functions.score import clamp, round_hundredths
from hustings.functions.text import (
    effective_text,
    excerpt,
    norm_quote,
    trim_spaces,
)
from hustings.operators.ids import dense_ids

# The reply formats.
TOPIC_REPLY = "array<struct<topic:string,salience:string,summary:string,source_quote:string>>"
STANCE_REPLY = "array<struct<question_id:string,stance:string,confidence:string,source_quote:string>>"
BATCH_REPLY = (
    "array<struct<index:int,primary:string,secondary:string,tags:array<string>,summary:string>>"
)
LABEL_REPLY = "struct<primary:string,secondary:string,tags:array<string>,summary:string>"
HEADER_REPLY = "struct<next_url:string,aggregate_urls:array<string>,note:string>"


# --- parsing -------------------------------------------------------------------


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row.

    A plain projection may be copied into every later use and every filter; parsing is
    too dear for that, and a generator's output is not copied.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def clean_reply(text: Column, shape: str = "array") -> Column:
    """The JSON of a reply without code fences.

    `array`: as it stands. `block`: the outermost {…} unless it starts with one.
    `outermost`: every fence removed, then from the first { to the last }.
    """
    if shape == "outermost":
        bare = F.regexp_replace(text, vocab.FENCE_PATTERN, "")
        found = F.regexp_extract(bare, vocab.OBJECT_PATTERN, 0)
        return F.when(found != "", found).otherwise(bare)
    bare = trim_spaces(text)
    opened = F.regexp_replace(bare, vocab.OPENING_FENCE_PATTERN, "")
    fenced = F.when(
        F.startswith(bare, F.lit("```")), F.regexp_replace(opened, vocab.CLOSING_FENCE_PATTERN, "")
    ).otherwise(bare)
    if shape == "array":
        return fenced
    found = F.regexp_extract(fenced, vocab.OBJECT_PATTERN, 0)
    return F.when(~F.startswith(fenced, F.lit("{")) & (found != ""), found).otherwise(fenced)


def repair_quotes(json: Column) -> Column:
    """Escape a quotation mark left bare inside a value."""
    return F.regexp_replace(json, vocab.BARE_QUOTE_PATTERN, r'$1\\"$2$3')


def _valid(json: Column) -> Column:
    return F.try_parse_json(json).isNotNull() & trim_spaces(json).rlike(r"[\]}]\z")


def parse_annotations(
    replies: DataFrame,
    schema: str,
    shape: str = "array",
    text: str = "response_text",
    numbers: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): `good` adds the column `parsed`, `rejects` a reason.

    A reply that does not parse is repaired once. Numbers that are none reject the
    whole reply.
    """
    tried = once(replies, _json=clean_reply(F.col(text), shape))
    json = F.col("_json")
    if shape == "array":
        # Only what does not parse as it stands is repaired and parsed again.
        tried = once(tried, _fix=F.when(~_valid(json), repair_quotes(json)))
        json = F.coalesce("_fix", json)
    parsed = F.when(_valid(json), F.from_json(json, schema))
    tried = once(tried, parsed=parsed).select(*replies.columns, "parsed")
    bad = F.lit(False)
    for name in numbers:
        given = F.col(f"parsed.{name}")
        bad = bad | F.exists(given, lambda x: x.isNotNull() & x.try_cast("double").isNull())
    reason = F.when(F.col("parsed").isNull(), "not JSON").when(bad, "bad number")
    good = tried.where(reason.isNull())
    return good, tried.withColumn("reason", reason).where("reason IS NOT NULL").drop("parsed")


def split_sentinel(
    df: DataFrame, raw: str, mark: str, note_size: int = vocab.MAX_NOTE_CHARS
) -> DataFrame:
    """Split column `raw` into a JSON header before the mark and a text after it.

    Adds manifesto_text, next_url, aggregate_urls and note; a header that does not
    parse leaves them empty.
    """
    text, at = F.col("_text"), F.instr("_text", mark)
    header = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    body = F.when(at > 0, F.substr(text, at + len(mark))).otherwise("")
    split = once(df, _text=trim_spaces(F.col(raw)))
    split = once(split, _head=clean_reply(header, "block"), manifesto_text=trim_spaces(body))
    head, meta = F.col("_head"), F.col("_meta")
    split = once(split, _meta=F.when(_valid(head), F.from_json(head, HEADER_REPLY)))
    return split.select(
        *[c for c in df.columns if c != raw],
        "manifesto_text",
        F.nullif(meta["next_url"], F.lit("")).alias("next_url"),
        meta["aggregate_urls"].alias("aggregate_urls"),
        F.substring(trim_spaces(F.coalesce(meta["note"], F.lit(""))), 1, note_size).alias("note"),
    )


# --- cleaning ------------------------------------------------------------------


def _first_of_each(items: Column, field: str, keep) -> Column:
    kept = F.filter(items, keep)
    return F.filter(kept, lambda x, i: F.array_position(kept[field], x[field]) == i + 1)


def _number(text: Column) -> Column:
    return round_hundredths(clamp(F.coalesce(text.try_cast("double"), F.lit(0.0))))


def _text(value: Column) -> Column:
    return trim_spaces(F.coalesce(value, F.lit("")))


def _checked(parsed: DataFrame, docs: DataFrame, items: Column) -> DataFrame:
    """(doc_id, i, ok): one row an item, and whether the document holds its quote.

    The quotes are looked up before the items are taken apart, so a document's text is
    normalised once and never copied to its items.
    """
    sources = docs.select("doc_id", norm_quote(F.col("text")).alias("_source"))
    found = F.transform("_items", lambda x: F.struct(x.alias("i"), _verified(_text(x["source_quote"])).alias("ok")))
    return (
        parsed.select("doc_id", items.alias("_items"))
        .where(F.size("_items") > 0)
        .join(sources, "doc_id")
        .select("doc_id", found.alias("_found"))
        .select("doc_id", F.explode("_found").alias("_f"))
        .select("doc_id", "_f.i", "_f.ok")
    )


def _verified(quote: Column) -> Column:
    return F.coalesce((quote != "") & F.contains(F.col("_source"), norm_quote(quote)), F.lit(False))


def clean_topics(
    parsed: DataFrame, docs: DataFrame, topics: Sequence[str] = tuple(vocab.TOPICS)
) -> DataFrame:
    """Known topics with clamped salience; a quote that is not in the text is blanked."""
    items = _first_of_each(F.col("parsed"), "topic", lambda x: x["topic"].isin(list(topics)))
    quote = _text(F.col("i.source_quote"))
    return _checked(parsed, docs, items).select(
        "doc_id",
        F.col("i.topic").alias("topic"),
        _number(F.col("i.salience")).alias("salience"),
        _text(F.col("i.summary")).alias("summary"),
        F.when(F.col("ok"), quote).otherwise("").alias("source_quote"),
    )


def clean_stances(parsed: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Stances on known questions; one whose quote is not in the text is demoted."""
    items = _first_of_each(F.col("parsed"), "question_id", lambda x: x["question_id"].isNotNull())
    quote = _text(F.col("i.source_quote"))
    stance = F.when(F.col("i.stance").isin(vocab.STANCES), F.col("i.stance")).otherwise("not_addressed")
    kept = F.when(F.col("ok"), stance).otherwise("not_addressed")
    checked = _checked(parsed, docs, items).select(
        "doc_id",
        F.col("i.question_id").alias("question_id"),
        kept.alias("stance"),
        _number(F.col("i.confidence")).alias("confidence"),
        F.when(kept == "not_addressed", "").otherwise(quote).alias("source_quote"),
    )
    return checked.join(questions.select("question_id"), "question_id", "left_semi")


QUESTION_BLOCK = 256


def fill_stances(stances: DataFrame, docs: DataFrame, questions: DataFrame, block: int = QUESTION_BLOCK) -> DataFrame:
    """Add a `not_addressed` row for every question a document has none for.

    Questions are dealt to blocks of about `block` ids. A document and a block are a row, whose
    lists (the block's ids and those the document has) are never longer than a block;
    only the missing ids are exploded. The block's ids are looked up last, so no shuffle or sort holds
    a copy of them for each document.
    """
    ids = questions.select("question_id").distinct()
    blocks = ids.select(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int")).scalar()

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("question_id"), blocks).cast("int"))

    every = dealt(ids).groupBy("block").agg(F.collect_set("question_id").alias("every"))
    present = dealt(stances.select("doc_id", "question_id")).groupBy("doc_id", "block").agg(
        F.collect_set("question_id").alias("present")
    )
    none = F.array().cast("array<string>")
    # The rows are few against those they make, so their size must not decide on the number of tasks.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missing = (
        docs.select("doc_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        .repartition(n, "doc_id", "block")
        .join(present, ["doc_id", "block"], "left")
        .join(every, "block")
        .select(
            "doc_id",
            F.explode(F.array_except("every", F.coalesce("present", none))).alias("question_id"),
        )
        .select(
            "doc_id",
            "question_id",
            F.lit("not_addressed").alias("stance"),
            F.lit(0.5).alias("confidence"),
            F.lit("").alias("source_quote"),
        )
    )
    return stances.select(*missing.columns).unionByName(missing)


def coerce_label(
    label: Column, vocabulary: Sequence[str] = tuple(vocab.TOPICS), default: str = vocab.FALLBACK_TOPIC
) -> Column:
    """A vocabulary entry: the label, else the first that contains it or is contained in it."""
    given = F.coalesce(label, F.lit(""))
    low = F.lower(given)
    near = [
        F.when(F.contains(F.lit(c.lower()), low) | F.contains(low, F.lit(c.lower())), F.lit(c))
        for c in vocabulary
    ]
    return F.coalesce(F.when(given.isin(list(vocabulary)), given), *near, F.lit(default))


def coerce_labels(
    labels: DataFrame,
    vocabulary: Sequence[str] = tuple(vocab.TOPICS),
    default: str = vocab.FALLBACK_TOPIC,
    max_tags: int = vocab.MAX_TAGS,
) -> DataFrame:
    """Replace primary, secondary and tags by valid ones."""
    second = F.col("secondary")
    return (
        labels.withColumn("primary", coerce_label(F.col("primary"), vocabulary, default))
        .withColumn("secondary", F.when(second.isin(list(vocabulary)), second))
        .withColumn("tags", F.slice("tags", 1, max_tags))
    )


def strict_label(
    label: Column, vocabulary: Sequence[str] = tuple(vocab.TOPICS), default: str = vocab.FALLBACK_TOPIC
) -> Column:
    return F.when(label.isin(list(vocabulary)), label).otherwise(default)


# --- batches -------------------------------------------------------------------


def batches(df: DataFrame, n: int, order: list, columns: Sequence[str]) -> DataFrame:
    """Cut a table in order into batches of n: (batch_id, items)."""
    numbered = dense_ids(df, order, "_no", start=0)
    item = F.struct((F.col("_no") % n + 1).cast("int").alias("index"), *columns)
    return numbered.groupBy(F.floor(F.col("_no") / n).alias("batch_id")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )


def batch_prompt_lines(batch: DataFrame, line) -> DataFrame:
    """The numbered lines sent for a batch; `line` maps an item to its text."""
    return batch.select(
        "batch_id",
        F.array_join(F.transform("items", lambda i: F.concat(i["index"].cast("string"), F.lit(". "), line(i))), "\n").alias(
            "lines"
        ),
    )


def align_batches(
    batched: DataFrame,
    replies: DataFrame,
    key: str,
    vocabulary: Sequence[str] = tuple(vocab.TOPICS),
    default: str = vocab.FALLBACK_TOPIC,
) -> DataFrame:
    """Give each reply back to the row its 1-based index names.

    Indexes outside the batch are dropped and of equal ones the last counts. All rows
    of a batch without a readable reply get the default label.
    """
    joined = batched.join(replies.select("batch_id", "parsed"), "batch_id", "left")
    results = joined.where("parsed IS NOT NULL").select(
        "batch_id", "items", F.posexplode("parsed").alias("pos", "r")
    )
    inside = results.where(F.col("r.index").between(1, F.size("items")))
    last = inside.groupBy("batch_id", F.col("r.index").alias("index")).agg(
        F.max_by(
            F.struct(F.element_at("items", F.col("r.index")).alias("item"), "r"), "pos"
        ).alias("x")
    )
    second = F.col("x.r.secondary")
    good = last.select(
        F.col(f"x.item.{key}").alias(key),
        strict_label(F.coalesce("x.r.primary", F.lit(default)), vocabulary, default).alias("primary"),
        F.when(second.isin([*vocabulary, ""]), second).alias("secondary"),
        F.coalesce("x.r.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("x.r.summary", F.lit("")).alias("summary"),
    )
    failed = joined.where("parsed IS NULL").select(F.explode("items").alias("item")).select(
        F.col(f"item.{key}").alias(key),
        F.lit(default).alias("primary"),
        F.lit(None).cast("string").alias("secondary"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("").alias("summary"),
    )
    return good.unionByName(failed)


def url_whitelist(replies: DataFrame, links: DataFrame, cap: int = vocab.MAX_OFFERED_URLS) -> DataFrame:
    """Keep suggested URLs only if the page offered them; a list wins over a single one.

    `links` holds a page's offered links, at most the link cap per page.
    """
    offered = links.groupBy("page_id").agg(F.collect_set("url").alias("offered"))
    none = F.array().cast("array<string>")
    wanted = F.transform(F.coalesce("aggregate_urls", none), trim_spaces)
    # array_intersect keeps the order of its first argument and drops repeats.
    kept = F.slice(F.array_intersect(wanted, F.coalesce("offered", none)), 1, cap)
    single = trim_spaces(F.col("next_url"))
    return (
        replies.join(offered, "page_id", "left")
        .withColumn("aggregate_urls", F.filter(kept, lambda u: u != ""))
        .withColumn(
            "next_url",
            F.when(
                (F.size("aggregate_urls") == 0) & (single != "") & F.array_contains("offered", single),
                single,
            ),
        )
        .drop("offered")
    )


# --- open work -----------------------------------------------------------------


def candidate_worklist(candidates: DataFrame, reclassify: bool = False) -> DataFrame:
    """Candidates with content that were never annotated, or whose better text is newer."""
    better = F.col("enhanced_manifesto_text")
    has_text = F.col("scrape_status").isin("ok", "low_content") | (F.coalesce(better, F.lit("")) != "")
    chosen = candidates.where(has_text)
    if not reclassify:
        chosen = chosen.where(
            "classified_at IS NULL OR enhanced_manifesto_fetched_at > classified_at"
        )
    return chosen.select(
        "candidate_id",
        "full_name",
        effective_text(better, F.col("manifesto_text")).alias("manifesto"),
        F.coalesce(
            F.nullif("enhanced_manifesto_word_count", F.lit(0)), "manifesto_word_count"
        ).alias("word_count"),
    ).orderBy(F.desc_nulls_last("word_count"), "candidate_id")


def pending_pages(props: DataFrame) -> DataFrame:
    return props.where(
        "(scrape_status = 'pending' OR scrape_status IS NULL) AND source_url IS NOT NULL"
    ).orderBy(F.desc("year"), "number")


def pending_sources(
    candidates: DataFrame,
    names: Sequence[str] = (),
    refind: bool = False,
    year: int = vocab.ELECTION_YEAR,
) -> DataFrame:
    chosen = candidates.where(F.col("election_year") == year)
    if names:
        chosen = chosen.where(F.col("full_name").isin(list(names)))
    elif not refind:
        chosen = chosen.where(
            "enhanced_manifesto_status IS NULL OR enhanced_manifesto_status = 'pending'"
        )
    return chosen.orderBy("full_name")


def annotation_worklist(
    props: DataFrame, rules: Sequence[Rule], excerpt_size: int = 2000, default: str = vocab.FALLBACK_TOPIC
) -> DataFrame:
    """Propositions without a summary, latest year first.

    Those neither the rules nor an earlier label classify need a label as well and
    come first within their year.
    """
    keyword = topic_rules(F.col("title"), rules)
    labelled = F.when(
        F.coalesce(F.col("topic_primary"), F.lit("")).isin("", default), None
    ).otherwise(F.col("topic_primary"))
    return (
        props.where(trim_spaces(F.coalesce("plain_language_summary", F.lit(""))) == "")
        .withColumn("topic", F.coalesce(keyword, labelled))
        .select(
            "proposition_id",
            "base_reference",
            "title",
            excerpt(F.col("scraped_text"), excerpt_size).alias("excerpt"),
            "year",
            "number",
            F.col("topic").isNull().alias("needs_category"),
            "topic",
        )
        .orderBy(F.desc("year"), F.desc("needs_category"), F.desc("number"), "proposition_id")
    )


def extended_worklist(
    props: DataFrame, divisions: DataFrame, since: str = vocab.TERM_START, excerpt_size: int = 2500
) -> DataFrame:
    """Propositions voted on this term that have a text but no long summary."""
    voted = divisions.where(
        F.col("date") >= F.lit(since).cast(divisions.schema["date"].dataType)
    ).select("proposition_id")
    return (
        props.where("extended_summary IS NULL AND scraped_text IS NOT NULL")
        .join(voted, "proposition_id", "left_semi")
        .withColumn("excerpt", F.substring("scraped_text", 1, excerpt_size))
        .orderBy(F.desc("year"), F.desc("number"))
    )
