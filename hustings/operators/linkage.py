"""Linking candidates to members by name."""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

import pandas as pd
import pyarrow as pa
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

from hustings import vocab
from hustings.functions.text import canonical_name, initial_key
from hustings.session import sized, stage


def _canonical(people: DataFrame, *columns: str) -> DataFrame:
    named = people.withColumn("canon", canonical_name(F.col("name")))
    return named.select(*columns, "name", "canon", initial_key(F.col("canon")).alias("key"))


def link_people(
    candidates: DataFrame, members: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """At most one member per candidate: (candidate_id, member_id, reason).

    `candidates` (candidate_id, slug, name), `members` (member_id, name), active ones
    only. An override wins, then the equal canonical name, then initial and last name
    where one member and one candidate share it. Of members with one canonical name
    the highest id counts.

    Each tier looks up a table with unique keys, so no tier multiplies rows however
    often a name repeats.
    """
    own = _canonical(candidates, "candidate_id", "slug")
    seats = _canonical(members, "member_id")
    by_name = seats.groupBy("canon").agg(F.max("member_id").alias("member_id"))
    sole_member = (
        seats.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.max("member_id").alias("initial_id"))
        .where("n = 1")
        .drop("n")
    )
    sole_candidate = (
        own.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    )
    sole = sole_member.join(sole_candidate, "key")
    linked = (
        own.join(by_name.withColumnRenamed("member_id", "exact_id"), "canon", "left")
        .join(sole, "key", "left")
    )
    if overrides is None:
        linked = linked.withColumn("override_id", F.lit(None).cast("long"))
    else:
        forced = (
            overrides.groupBy("slug")
            .agg(F.max_by("member_name", "row_no").alias("member_name"))
            .select("slug", canonical_name(F.col("member_name")).alias("canon"))
            .join(by_name, "canon")
            .select("slug", F.col("member_id").alias("override_id"))
        )
        linked = linked.join(forced, "slug", "left")
    tiers = [("override_id", "override"), ("exact_id", "exact"), ("initial_id", "initial-unique")]
    return linked.select(
        "candidate_id",
        F.coalesce(*[c for c, _ in tiers]).alias("member_id"),
        F.coalesce(*[F.when(F.col(c).isNotNull(), r) for c, r in tiers]).alias("reason"),
    ).where("member_id IS NOT NULL")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _segments(name: Column, count: Column) -> Column:
    """array<struct(no, at, part)>: a name cut into `count` even pieces."""
    size = F.length(name)

    def piece(i: Column) -> Column:
        begin = F.floor(i * size / count)
        stop = F.floor((i + 1) * size / count)
        return F.struct(
            i.alias("no"),
            (begin + 1).cast("int").alias("at"),
            F.substr(name, (begin + 1).cast("int"), (stop - begin).cast("int")).alias("part"),
        )

    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), piece)


SPARE = 4  # letters of a piece from which a spare piece pays
CELL = 2_000  # rows of one key that meet at once, on each side


def split_join(left: DataFrame, right: DataFrame, on: list[str], cell: int = CELL) -> DataFrame:
    """An inner join whose frequent keys are dealt to a grid of tasks.

    A key with more than `cell` rows on a side has these cut into parts by a hash of the whole
    row; every part of one side meets every part of the other one, so no task holds more than
    about `cell` rows of a key from either side. Both sides should be staged.
    """
    both = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = both.groupBy(on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    heavy = sized(counts.where(f"_l > 0 AND _r > 0 AND greatest(_l, _r) > {cell}"), "heavy-keys")

    def parts(count: str) -> Column:
        return F.coalesce(F.ceil(F.col(count) / cell), F.lit(1)).cast("long")

    def dealt(rows: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        return rows.join(heavy, on, "left").select(
            *rows.columns,
            F.pmod(F.xxhash64(*rows.columns), parts(own_count)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), parts(other_count) - 1)).alias(other),
        )

    # The rows are few against the pairs they make, so their size must not decide on the number of tasks.
    at, n = [*on, "_i", "_j"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = dealt(left, "_i", "_l", "_j", "_r").repartition(n, *at).join(
        dealt(right, "_j", "_r", "_i", "_l").repartition(n, *at).hint("shuffle_hash"), at
    )
    return joined.drop("_i", "_j")


def _letters(name: Column) -> Column:
    """The letters of a name, the n-th of a kind apart from the others: e1, e2, …"""
    letters = F.split(name, "")
    return F.transform(
        letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).cast("string"))
    )


def _edits(threshold: float, size_a: Column, size_b: Column) -> Column:
    """The edits that names of these lengths may be apart."""
    return F.floor((1.0 - threshold) * (size_a + size_b) + 1e-9).cast("int")


def _pieces(threshold: float, size: Column) -> Column:
    """How many pieces a name is cut into: one more than the edits of any partner."""
    reach = (2.0 - threshold) / threshold
    return _edits(threshold, size, F.floor(size * reach + 1e-9)) + 1


LEFT_OUT = 3  # letters that a name may lack in its partner, to be found by the letters they share
LONGEST = 20  # of names that are: 20 letters without three are 1,140 sets
DRAWN = 1 << 16  # sets of letters that a task returns at once


def _common(threshold: float, size_a: Column, size_b: Column) -> Column:
    """The letters that names of these lengths share at least."""
    return F.ceil(threshold * (size_a + size_b) / 2 - 1e-9).cast("int")


def _few_missing(threshold: float, size_a: Column, size_b: Column) -> Column:
    """Whether pairs of these lengths are found by the letters they share."""
    most = F.greatest(size_a, size_b)
    return (most - _common(threshold, size_a, size_b) <= LEFT_OUT) & (most <= LONGEST)


def _partner_lengths(threshold: float, size: Column) -> Column:
    reach = (2.0 - threshold) / threshold
    return F.sequence(F.greatest(F.ceil(size / reach - 1e-9).cast("int"), F.lit(1)), F.floor(size * reach + 1e-9).cast("int"))


def _dealt(names: DataFrame) -> DataFrame:
    """Names dealt to all tasks: they are few against the rows they make, so their size must not decide on that number.

    By a hash of the name, as Spark drops a repartition by the column that it has just made distinct.
    """
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(names.columns[0]))


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set of `m` letters of a name, whatever their order."""

    def drawn(at: list[int], sets: list[str]) -> pa.RecordBatch:
        taken = batch.take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([*[taken.column(c) for c in ("name", "la", "lb")], pa.array(sets, pa.string())], names=["name", "la", "lb", "part"])

    for batch in batches:
        at, sets = [], []
        for i, (name, m) in enumerate(zip(batch.column("name").to_pylist(), batch.column("m").to_pylist())):
            own = {"".join(c) for c in combinations(sorted(name), m)}
            at += [i] * len(own)
            sets += own
            if len(sets) >= DRAWN:
                yield drawn(at, sets)
                at, sets = [], []
        yield drawn(at, sets)


def _by_shared(probes: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) whose lengths leave few letters that are not shared.

    Such names share a set of as many letters as they must, so each is entered under all sets
    that remain when the others are left out. Names of many letters in common are few, where those
    with a piece of two or three letters in common are most.
    """

    def sets(names: DataFrame, own: str) -> DataFrame:
        size, other = F.length(own), F.explode(_partner_lengths(threshold, F.length(own))).alias("other")
        met = _dealt(names).select(own, size.alias("size"), other)
        la, lb = ("size", "other") if own == "a" else ("other", "size")
        met = met.select(F.col(own).alias("name"), F.col(la).alias("la"), F.col(lb).alias("lb"))
        met = met.where(_few_missing(threshold, F.col("la"), F.col("lb")))
        m = _common(threshold, F.col("la"), F.col("lb"))
        drawn = met.withColumn("m", m).where(F.col("m") <= F.least("la", "lb")).mapInArrow(_draw, "name string, la int, lb int, part string")
        return drawn.select(F.xxhash64("la", "lb", "part").alias("key"), F.col("name").alias(own))

    return split_join(stage(sets(probes, "a"), "sets"), stage(sets(targets, "b"), "sets"), ["key"]).select("a", "b")


def _by_pieces(probes: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) by a shared piece, for targets that are long enough to be cut and pairs
    that `_by_shared` does not find.

    A name cut into one piece more than it needs has two that are unchanged in any partner, so
    the most frequent of its pieces may go. That is done where pieces stay long enough to be rare.
    """
    size, need = F.length("b"), _pieces(threshold, F.length("b"))
    cut = F.when(size >= SPARE * (need + 1), need + 1).otherwise(need)
    pieces = targets.select("b", size.alias("lb"), need.alias("need"), F.explode(_segments(F.col("b"), cut)).alias("s"))
    index = pieces.select("b", "lb", "need", "s.no", "s.part")
    if SPARE * (1.0 - threshold) * 2.0 / threshold < 1.0:  # else no name is long enough for a spare piece
        index = stage(index, "pieces")
        often = index.groupBy("lb", "no", "part").agg(F.count("*").alias("often"))
        rare = Window.partitionBy("b").orderBy("often", "no")
        index = index.join(often, ["lb", "no", "part"]).withColumn("place", F.row_number().over(rare)).where("place <= need")
    index = stage(index.select("lb", "no", "part", "b"), "piece-index")

    spread = _dealt(probes).select("a", F.explode(_partner_lengths(threshold, F.length("a"))).alias("lb"))
    spread = spread.where(~_few_missing(threshold, F.length("a"), F.col("lb")))
    need = _pieces(threshold, F.col("lb"))
    spread = spread.withColumn("n", F.when(F.col("lb") >= SPARE * (need + 1), need + 1).otherwise(need)).where(need <= F.col("lb"))
    spread = spread.withColumn("shift", _edits(threshold, F.length("a"), F.col("lb")))
    cuts = spread.select("a", "lb", "n", "shift", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no"))
    begin = F.floor(F.col("no") * F.col("lb") / F.col("n")).cast("int")
    width = F.floor((F.col("no") + 1) * F.col("lb") / F.col("n")).cast("int") - begin
    first = F.greatest(F.col("begin") - F.col("shift"), F.lit(0))
    last = F.least(F.col("begin") + F.col("shift"), F.length("a") - F.col("width"))
    parts = F.transform(F.sequence(first, last), lambda at: F.substr(F.col("a"), at + 1, F.col("width")))
    sliced = (
        cuts.withColumn("begin", begin)
        .withColumn("width", width)
        .where(last >= first)
        .select("lb", "no", F.explode(F.array_distinct(parts)).alias("part"), "a")
    )
    return split_join(stage(sliced, "slices"), index, ["lb", "no", "part"]).select("a", "b")


def _by_letters(probes: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) by a shared rare letter: of two names that share m letters, each has one
    of the shared ones among all but its m - 1 most frequent letters."""
    reach = (2.0 - threshold) / threshold

    def letters(names: DataFrame, name: str) -> DataFrame:
        return names.select(name, F.explode(_letters(F.col(name))).alias("letter"))

    mine, theirs = stage(letters(probes, "a"), "letters"), stage(letters(targets, "b"), "letters")
    often = sized(
        mine.select("letter").unionByName(theirs.select("letter")).groupBy("letter").agg(F.count("*").alias("often")), "letter-counts"
    )

    def prefix(rows: DataFrame, name: str) -> DataFrame:
        size = F.length(name)
        least = F.ceil(threshold * (size + F.greatest(F.ceil(size / reach - 1e-9), F.lit(1))) / 2 - 1e-9)
        place = F.row_number().over(Window.partitionBy(name).orderBy("often", "letter"))
        placed = rows.join(often, "letter").withColumn("place", place)
        return stage(placed.where(F.col("place") <= size - least + 1).select("letter", name), "letter-index")

    return split_join(prefix(mine, "a"), prefix(theirs, "b"), ["letter"]).select("a", "b")


def near_pairs(probes: DataFrame, targets: DataFrame, threshold: float = vocab.NEAR_MISS_RATIO) -> DataFrame:
    """All pairs (a, b) of the distinct names of two sides that may have a ratio of `threshold`.

    The ratio 2·M/(|a|+|b|) counts M characters in common order. Names at or above the
    threshold are at most (1-t)(|a|+|b|) edits apart and share t(|a|+|b|)/2 letters at least;
    exactly the pairs within both bounds are returned. They are found by the set of letters they
    share, or, where that leaves out too many, by an unchanged piece of the target's name, shifted by no more than the edits. Where a threshold is so low
    that a target would need more pieces than it has letters, a shared rare letter takes
    their place.
    """
    a = probes.select("a").where("a <> ''").distinct()
    b = targets.select("b").where("b <> ''").distinct()
    whole = _pieces(threshold, F.length("b")) <= F.length("b")
    found = _by_pieces(a, b.where(whole), threshold).unionByName(_by_shared(a, b, threshold))
    # Pieces never outnumber letters unless (1-t)·2/t reaches 1.
    if (1.0 - threshold) * 2.0 / threshold + 1e-6 >= 1.0:
        found = found.unionByName(_by_letters(a, b.where(~whole), threshold))
    total = F.length("a") + F.length("b")
    shared = F.size(F.array_intersect(_letters(F.col("a")), _letters(F.col("b"))))
    # Written first: as a part of the join's condition the letters would be counted for every candidate, whatever its edits.
    edits = F.call_function("levenshtein", F.col("a"), F.col("b"), _edits(threshold, F.length("a"), F.length("b")))  # -1 beyond these
    near = stage(found.where(edits >= 0).distinct(), "near")
    return near.where(shared >= threshold * total / 2 - 1e-9)


def near_misses(
    candidates: DataFrame,
    members: DataFrame,
    links: DataFrame,
    threshold: float = vocab.NEAR_MISS_RATIO,
) -> DataFrame:
    """For each unlinked candidate the most similar member name, if similar enough.

    Names are made distinct first, so copies are compared once; the ratio is worked out for
    the pairs of `near_pairs` alone.
    """
    seats = _canonical(members, "member_id").where("canon <> ''")
    targets = stage(
        seats.groupBy("canon").agg(F.max("member_id").alias("member_id"), F.max_by("name", "member_id").alias("member_name")), "seats"
    )
    open_ = stage(_canonical(candidates, "candidate_id", "slug").join(links, "candidate_id", "left_anti"), "unlinked")
    pairs = (
        near_pairs(open_.select(F.col("canon").alias("a")), targets.select(F.col("canon").alias("b")), threshold)
        .withColumn("ratio", _ratio(F.col("a"), F.col("b")))
        .where(F.col("ratio") >= threshold)
    )
    best = pairs.groupBy("a").agg(
        F.min_by(F.struct("b", "ratio"), F.struct((-F.col("ratio")).alias("r"), "b")).alias("m")
    )
    return (
        open_.join(best.select(F.col("a").alias("canon"), "m"), "canon")
        .join(targets.select(F.col("canon").alias("b"), "member_id", "member_name"), F.col("m.b") == F.col("b"))
        .select("candidate_id", "slug", "name", "member_id", "member_name", F.col("m.ratio").alias("ratio"))
    )


def link_collisions(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """People behind keys held by several candidates and some member, one row each.

    One row a person instead of lists of names: a key may be held by any number.
    """
    own = _canonical(candidates, "candidate_id").where("key IS NOT NULL")
    seats = _canonical(members, "member_id").where("key IS NOT NULL")
    shared = (
        own.groupBy("key")
        .agg(F.count("*").alias("n_candidates"))
        .where("n_candidates > 1")
        .join(seats.groupBy("key").agg(F.count("*").alias("n_members")), "key")
    )

    def side(people: DataFrame, kind: str, id_: str) -> DataFrame:
        return people.join(shared, "key").select(
            "key",
            "n_candidates",
            "n_members",
            F.lit(kind).alias("kind"),
            F.col(id_).alias("person_id"),
            "name",
        )

    return side(own, "candidate", "candidate_id").unionByName(side(seats, "member", "member_id"))


def apply_links(candidates: DataFrame, links: DataFrame, clear: bool = False) -> DataFrame:
    """Write links to the candidates; `clear` forgets the earlier ones first."""
    old = F.lit(None).cast("long") if clear else F.col("incumbent_member_id")
    found = links.select("candidate_id", F.col("member_id").alias("_new"))
    return (
        candidates.join(found, "candidate_id", "left")
        .withColumn("incumbent_member_id", F.coalesce("_new", old))
        .drop("_new")
    )
