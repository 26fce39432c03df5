"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens is handed down a tree (domain, language, source). A node's children share
its budget in proportion to their weights, but none gets more than its leaves can supply in
`max_epochs` epochs: what one cannot take goes to its siblings, and a node asks its own
parent for no more than its whole subtree can take, so a shortage reaches an ancestor's
other children only when all siblings are full. A leaf then takes whole epochs and, of one
more, the first documents of a seeded order, as long as their tokens fit.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hustings.llm.common import WORDS, Scratch, table
from hustings.llm.registry import query
from hustings.session import SIZED

LEVELS = ("domain", "lang", "source")
BUCKETS = 4096  # parts of a leaf's seeded order: three hexadecimal digits
NONE = "(none)"
SALTS = 64  # groups of a leaf where the leaves are too many for a broadcast


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """`nodes` (…, cap, weight, given) with `budget`: their parents' `given` shared by weight.

    Children sorted by the weight share at which they are full: one is full exactly if what
    is left for it and all after it would fill it. Then the others share the rest.
    """
    own = [*parent]
    ratio = F.col("cap") / F.col("weight")
    before = Window.partitionBy(*own).orderBy(ratio, "name").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*own)
    left = (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    marked = nodes.withColumn("_full", left >= ratio)
    taken = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0)).over(every)
    part = F.floor(F.col("weight") * (F.col("given") - taken) / open_weight)
    return marked.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_full")


def budgets(
    leaves: DataFrame,
    budget: int,
    max_epochs: int,
    weights: Mapping[tuple, int] | None = None,
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """`leaves` (levels…, tokens) with `budget`.

    A node's weight is that of its path in `weights`, else the rounded root of its tokens.
    Weights are whole numbers, so sums do not depend on their order. The tables here have a row
    per node of the tree.
    """
    spark = leaves.sparkSession
    given = None
    for k, level in enumerate(levels):
        path, above = list(levels[: k + 1]), list(levels[:k])
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens"))
        weight = F.greatest(F.lit(1), F.round(F.sqrt("tokens"))).cast("long")
        chosen = {p: w for p, w in (weights or {}).items() if len(p) == k + 1}
        if chosen:
            known = spark.createDataFrame(
                [(*p, int(w)) for p, w in chosen.items()], [*path, "_weight"]
            )
            nodes = nodes.join(F.broadcast(known), path, "left")
            weight = F.coalesce("_weight", weight)
        nodes = nodes.select(
            *path, F.col(level).alias("name"), (F.col("tokens") * max_epochs).alias("cap"), weight.alias("weight")
        )
        if given is None:
            nodes = nodes.withColumn("given", F.least(F.lit(budget), F.sum("cap").over(Window.partitionBy())))
        else:
            nodes = nodes.join(given, above)
        given = share(nodes, above).select(*path, F.col("budget").cast("long").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), list(levels))


def with_leaf(rows: DataFrame, leaves: DataFrame, path: Sequence[str]) -> DataFrame:
    """`rows` with the columns of their leaf.

    Up to `SIZED` leaves are broadcast. More are joined by a shuffle in which every leaf has a
    copy for each of 64 salts, so that the rows of a large one are 64 groups.
    """
    if leaves.count() <= SIZED:
        return rows.join(F.broadcast(leaves), list(path))
    salt = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")
    copies = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*path, "_salt"]).drop("_salt")


def mix(
    docs: DataFrame,
    budget: int | None = None,
    max_epochs: int = 4,
    weights: Mapping[tuple, int] | None = None,
    seed: int = 17,
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """The chosen rows of `docs` as (row, n_tokens, epoch), once per epoch (from 1); `row` is the struct of all columns.

    `docs` has doc_id, text and the columns `levels`; a null there is a node of its own. The
    budget defaults to all tokens of `docs`. Epoch e orders a leaf's rows by
    md5(seed:e:doc_id), equal ids by their tokens. Leaves without a token, and an empty
    table, give nothing.

    Running sums are taken over 4,096 parts of a leaf's order, which are summed before their
    shuffle; only the part in which the budget ends is ordered row by row. Texts
    are not shuffled beyond that part while there are at most 500,000 leaves, which are
    counted and broadcast; beyond that the rows of a leaf are salted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    path = list(levels)
    sized = docs.select(
        "doc_id",
        *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels],
        token_count().alias("n_tokens"),
        F.struct(*docs.columns).alias("row"),
    )
    narrow = scratch.save(sized.drop("row"), "sizes")
    leaves = narrow.groupBy(*path).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    leaves = scratch.save(leaves, "leaves")
    if budget is None:
        budget = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    plan = budgets(leaves, budget, max_epochs, weights, path)
    plan = scratch.save(
        plan.select(
            *path,
            F.expr("budget div tokens").alias("whole"),
            (F.col("budget") % F.col("tokens")).alias("rest"),
        ),
        "plan",
    )
    order = F.md5(
        F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("doc_id").cast("string")).cast("binary")
    )
    part = F.substring(order, 1, 3).alias("part")
    parts = with_leaf(narrow, plan.where("rest > 0"), path).groupBy(*path, "rest", part).agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*path).orderBy("part")
    border = (
        parts.withColumn("end", F.sum("n").over(upto)).where("end > rest")
        .groupBy(*path).agg(F.min("part").alias("border"), F.min_by(F.col("end") - F.col("n"), "part").alias("before"))
    )
    plan = scratch.save(plan.join(border, path, "left"), "borders")
    rows = with_leaf(sized, plan, path).withColumn("order", order)
    place = F.substring("order", 1, 3)
    epochs = F.when(place < F.col("border"), F.col("whole") + 1).otherwise(F.col("whole"))
    sure = rows.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(1).cast("long"), epochs))))
    running = Window.partitionBy(*path).orderBy("order", "doc_id", "n_tokens").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    edge = (
        rows.where(place == F.col("border")).withColumn("sum", F.sum("n_tokens").over(running))
        .where(F.col("before") + F.col("sum") <= F.col("rest"))
        .withColumn("epoch", F.col("whole") + 1)
    )
    return sure.select("row", "n_tokens", "epoch").unionByName(edge.select("row", "n_tokens", "epoch"))


def domain(source: str = "source") -> Column:
    """`documents` has no domains: sources are dealt to three by their last character."""
    return F.concat(F.lit("d"), (F.ascii(F.right(F.col(source), F.lit(1))) % 3).cast("string"))


def _level(path: str, above: str, given: str, name: str) -> str:
    """SQL of one level: `name` holds the nodes' budgets; `given` their parents'."""
    own = f"PARTITION BY {above}" if above else ""
    join = f"JOIN {given} USING ({above})" if above else f"CROSS JOIN {given}"
    return f"""
{name}_nodes AS (
  SELECT {path}, 4 * sum(tokens) AS cap, greatest(1, round(sqrt(sum(tokens))))::BIGINT AS weight FROM leaves GROUP BY {path}
), {name}_given AS (SELECT * FROM {name}_nodes {join}),
{name}_left AS (
  SELECT *, (given - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER every - coalesce(sum(weight) OVER before, 0)) >= cap / weight AS is_full
  FROM {name}_given WINDOW every AS ({own}),
    before AS ({own} ORDER BY cap / weight, {path.split(", ")[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {name} AS (
  SELECT {path}, CASE WHEN is_full THEN cap ELSE floor(weight * (given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER every)
    / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER every) END::BIGINT AS given
  FROM {name}_left WINDOW every AS ({own})
)"""


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, lang, source, 'd' || (ascii(right(source, 1)) % 3) AS domain,
    coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM sized GROUP BY ALL HAVING sum(n_tokens) > 0
), root AS (SELECT sum(tokens)::BIGINT AS given FROM leaves),
{_level("domain", "", "root", "by_domain")},
{_level("domain, lang", "domain", "by_domain", "by_lang")},
{_level("domain, lang, source", "domain, lang", "by_lang", "by_source")},
plan AS (SELECT *, given // tokens AS whole, given % tokens AS rest FROM leaves JOIN by_source USING (domain, lang, source)),
ordered AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || (whole + 1) || ':' || doc_id), doc_id, n_tokens
    ROWS UNBOUNDED PRECEDING) AS upto FROM sized JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, whole + 1 + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch
FROM ordered
"""


@query("op9_mixing", ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain())
    return mix(docs).select("row.doc_id", "row.domain", "row.lang", "row.source", "n_tokens", "epoch")
