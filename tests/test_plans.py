"""The plans are the ones intended: pushdown, partial aggregation, no pair joins."""

import pytest

import __spark_entry__ as contract
from hustings.operators import ingest

QUERIES = contract.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["alignment", "respondent_match", "candidate_match", "fill_stances", "near_misses"])
def test_no_cross_join(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_dedupe_is_aggregated_before_its_shuffle(spark):
    rows = spark.range(100).selectExpr(
        "id % 7 AS division_id", "id % 5 AS member_id", "'Pour' AS vote", "id AS row_no"
    )
    before, after = plan(ingest.dedupe_votes(rows)).split("Exchange hashpartitioning(division_id")
    assert "partial_min_by" in after and "partial_min_by" not in before
    assert "member_id" in after.split(")")[0]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["participation"](spark, sf_dir))
    assert "GreaterThanOrEqual(date" in text
    assert "proposition_title" not in text.split("ReadSchema")[1]


def test_active_members_are_a_semi_join(spark, sf_dir):
    assert plan(QUERIES["vote_matrix"](spark, sf_dir)).count("LeftSemi") == 2


@pytest.mark.parametrize("name", ["page_text", "internal_links", "contacts", "sections", "quote_check", "topic_rules"])
def test_page_and_document_work_stays_in_the_row(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text and "BatchEvalPython" not in text


def test_latest_votes_are_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["member_recent_votes"](spark, sf_dir))


def test_questions_are_not_shuffled_with_the_documents(spark, sf_dir):
    # A copy of a block's ids for each document made one sort of 856 MB of them.
    text = plan(QUERIES["fill_stances"](spark, sf_dir))
    filled = text.split("array_except(")[1]
    assert filled.index("every") < filled.index("Exchange")
    keyed = [line for line in filled.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    below = [filled.splitlines()[filled.splitlines().index(line) + 1] for line in keyed]
    assert keyed and not any("every" in line for line in below)
