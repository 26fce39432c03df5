"""Maintained tables: each job returns the next version of a table.

A batch is usually small against the table it changes. Every job therefore joins the
table with the batch from the left, so that Spark can broadcast a small batch and
leave the table where it is.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from hustings.session import stage


def _order(df: DataFrame, order: str | None):
    """What orders the rows of a batch: a column, or else the rows themselves."""
    return F.struct(F.col(order)) if order else F.struct(*[F.col(c) for c in df.columns])


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    policy: Mapping[str, str] | None = None,
    order: str | None = None,
) -> DataFrame:
    """Insert or update by key. Columns of `policy`:

    `replace` takes the new value (the default), `fill` the new one unless it is null,
    `keep` never changes a stored value. Columns that `new` lacks are kept, and null in
    inserted rows.

    A key may come several times in `new`: the result is that of one row after the other, by
    the column `order` (which is not stored unless the table has it). Without one,
    equal keys are ordered by their values, so the result is still one row per key.
    """
    policy = dict(policy or {})
    given = [c for c in new.columns if c not in keys and c in old.columns]
    at = _order(new, order)

    def last(c: str):
        rule = policy.get(c, "replace")
        if rule == "fill":
            return F.max_by(c, F.when(F.col(c).isNotNull(), at))
        # What is never changed is what the first row inserted.
        return (F.min_by if rule == "keep" else F.max_by)(F.struct(c), at)[c]

    batch = stage(
        new.groupBy(*keys).agg(F.struct(F.lit(True).alias("_seen"), *[last(c).alias(c) for c in given]).alias("_new")), "batch"
    )

    def merged(c: str):
        rule = policy.get(c, "replace") if c in given else "keep"
        if rule == "keep":
            return F.col(c)
        value = F.col(f"_new.{c}")
        if rule == "fill":
            value = F.coalesce(value, F.col(c))
        return F.when(F.col("_new").isNotNull(), value).otherwise(F.col(c)).alias(c)

    updated = old.join(batch, list(keys), "left").select(
        *[F.col(c) if c in keys else merged(c) for c in old.columns]
    )
    inserted = batch.join(old.select(*keys), list(keys), "left_anti").select(
        *[
            F.col(c) if c in keys
            else (F.col(f"_new.{c}") if c in given else F.lit(None)).cast(old.schema[c].dataType).alias(c)
            for c in old.columns
        ]
    )
    return updated.unionByName(inserted)


# Policies of the candidate table: contact and description fields keep what they have,
# a removal and the review token are never touched.
PROFILE_POLICY = {
    "role": "fill",
    "constituency": "fill",
    "party": "fill",
    "photo_url": "fill",
    "email": "fill",
    "phone": "fill",
    "opted_out_at": "keep",
    "correction_token": "keep",
    "election_year": "keep",
}


def replace_children(
    old: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None
) -> DataFrame:
    """Drop all rows of the touched parents and add the new ones."""
    touched = new if touched is None else touched
    kept = old.join(touched.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def mark_classified(old: DataFrame, finished: DataFrame, key: str, now, column: str = "classified_at") -> DataFrame:
    """Stamp the rows whose annotation is finished, so that work lists leave them out."""
    done = finished.select(key).distinct().withColumn("_done", F.lit(True))
    stamp = F.when(F.col("_done"), now).otherwise(F.col(column)).alias(column)
    return old.join(done, key, "left").select(*[stamp if c == column else F.col(c) for c in old.columns])


SOURCE_FIELDS = ["status", "text", "word_count", "source_url", "source_label", "notes"]
# The columns of the candidate table that hold the outcome of a source search.
CANDIDATE_SOURCE = {f: f"enhanced_manifesto_{f}" for f in [*SOURCE_FIELDS, "fetched_at"]}


def update_source(
    old: DataFrame,
    updates: DataFrame,
    key: str,
    now,
    columns: Mapping[str, str] | None = None,
    order: str | None = None,
) -> DataFrame:
    """Take over the outcome of a source search; the fetch time moves only when found.

    `updates` holds the key and status, text, word_count, source_url, source_label and
    notes; a column it leaves null is stored as null. `columns` names the columns of the
    table, by default the same. Of several outcomes of a key the last by `order` is stored,
    and the time moves if one of them was found.
    """
    at = _order(updates, order)
    outcome = updates.groupBy(key).agg(
        F.max_by(F.struct(*SOURCE_FIELDS), at).alias("_new"), F.max(F.coalesce(F.col("status") == "found", F.lit(False))).alias("_found")
    )
    place = {f: (columns or {}).get(f, f) for f in [*SOURCE_FIELDS, "fetched_at"]}
    seen = F.col("_new").isNotNull()
    values = {place[f]: F.when(seen, F.col(f"_new.{f}")).otherwise(F.col(place[f])) for f in SOURCE_FIELDS}
    values[place["fetched_at"]] = F.when(F.col("_found"), now).otherwise(F.col(place["fetched_at"]))
    return old.join(outcome, key, "left").select(
        *[values[c].alias(c) if c in values else F.col(c) for c in old.columns]
    )


def apply_topics(props: DataFrame, keyword: DataFrame, replied: DataFrame) -> DataFrame:
    """Write labels: `keyword` (proposition_id, topic, tags, summary) leaves the second
    topic alone, `replied` (proposition_id, primary, secondary, tags, summary) sets it."""
    by_rule = keyword.select(
        "proposition_id",
        F.col("topic").alias("_primary"),
        F.lit(None).cast("string").alias("_secondary"),
        F.col("tags").alias("_tags"),
        F.col("summary").alias("_summary"),
        F.lit(False).alias("_both"),
    )
    by_reply = replied.select(
        "proposition_id",
        F.col("primary").alias("_primary"),
        F.col("secondary").alias("_secondary"),
        F.col("tags").alias("_tags"),
        F.col("summary").alias("_summary"),
        F.lit(True).alias("_both"),
    )
    labelled = F.col("_both").isNotNull()

    def take(new, old: str):
        return F.when(labelled, new).otherwise(F.col(old))

    second = F.when(F.col("_both"), F.col("_secondary")).otherwise(F.col("topic_secondary"))
    merged = props.join(by_rule.unionByName(by_reply), "proposition_id", "left").select(
        *[c for c in props.columns if c not in LABEL_COLUMNS],
        take(F.col("_primary"), "topic_primary").alias("topic_primary"),
        second.alias("topic_secondary"),
        take(F.col("_tags"), "topic_tags").alias("topic_tags"),
        take(F.col("_summary"), "plain_language_summary").alias("plain_language_summary"),
    )
    return merged.select(*props.columns)


LABEL_COLUMNS = ["topic_primary", "topic_secondary", "topic_tags", "plain_language_summary"]


def soft_delete(table: DataFrame, requests: DataFrame, now, token: str = "correction_token") -> DataFrame:
    """Mark the rows whose token was sent; a row marked earlier keeps its time."""
    asked = requests.where(F.col(token).isNotNull()).select(token).distinct().withColumn(
        "_asked", F.lit(True)
    )
    marked = F.when(F.col("_asked"), F.coalesce("opted_out_at", now)).otherwise(F.col("opted_out_at"))
    return (
        table.join(asked, token, "left").withColumn("opted_out_at", marked).select(*table.columns)
    )


def party_document(candidates: DataFrame, documents: DataFrame, now) -> DataFrame:
    """Give every member of a party the document the party publishes.

    `documents` holds party, text, word_count, source_url and notes; of several rows of a
    party that with the greatest values is taken.
    """
    content = F.struct("text", "word_count", "source_url", "notes")
    shared = documents.where("text <> ''").groupBy(F.lower("party").alias("_party")).agg(F.max(content).alias("_doc"))
    doc = F.col("_doc")
    values = {
        "enhanced_manifesto_status": F.lit("found"),
        "enhanced_manifesto_text": doc["text"],
        "enhanced_manifesto_word_count": doc["word_count"],
        "enhanced_manifesto_source_url": doc["source_url"],
        "enhanced_manifesto_source_label": F.lit("party_manifesto"),
        "enhanced_manifesto_notes": doc["notes"],
        "enhanced_manifesto_fetched_at": now,
    }
    joined = candidates.withColumn("_party", F.lower("party")).join(shared, "_party", "left")
    return joined.select(
        *[
            F.when(doc.isNotNull(), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in candidates.columns
        ]
    )
