"""Ordered keyword rules over a lowercased title.

The rules are data: pass a list, or load one with `read_rules` from a table with the
columns ordinal, category, kind (`match` or `unless`) and pattern.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

class Rule(NamedTuple):
    category: str
    patterns: Sequence[str]
    unless: Sequence[str] = ()


def read_rules(table: DataFrame) -> list[Rule]:
    """Rules from a table: a vocabulary that becomes part of the query's text."""
    rules: dict[int, Rule] = {}
    for line in table.orderBy("ordinal", "kind", "pattern").collect():
        rule = rules.setdefault(line["ordinal"], Rule(line["category"], [], []))
        (rule.unless if line["kind"] == "unless" else rule.patterns).append(line["pattern"])
    return [rules[k] for k in sorted(rules)]


def any_of(patterns: Sequence[str]) -> str:
    """One alternation; `.` stops at a newline only and classes follow Unicode."""
    return "(?Ud)" + "|".join(f"(?:{p})" for p in patterns)


def topic_rules(title: Column, rules: Sequence[Rule]) -> Column:
    """Category of the first rule that matches and is not excluded; null without one."""
    low = F.lower(title)

    def applies(rule: Rule) -> Column:
        hit = low.rlike(any_of(rule.patterns))
        return ~low.rlike(any_of(rule.unless)) & hit if rule.unless else hit

    return F.coalesce(*[F.when(applies(r), F.lit(r.category)) for r in rules])
