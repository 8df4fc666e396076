"""Keyword rules by one automaton over all keywords.

Each Python worker builds an Aho-Corasick automaton of the distinct keywords once and reads
every text once, whatever the number of rules; a rule table of thousands is no theta
join. The matched keywords of a text come back as indexes and are joined to the rules
by equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AUTOMATA: dict[tuple, object] = {}


def keyword_finder(keywords: list[str]):
    """A Column function: text -> rising indexes (into ``keywords``) of those that are substrings of the
    text; null for a null text. An empty keyword is in every text."""
    distinct = sorted(set(keywords))
    places = {k: [i for i, other in enumerate(keywords) if other == k] for k in distinct} if len(distinct) < len(keywords) else {
        k: [i] for i, k in enumerate(keywords)}
    named = [k for k in distinct if k]
    always = places.get("", [])

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k in named:
            automaton.add_word(k, places[k])
        if named:
            automaton.make_automaton()

        def of(text):
            if text is None:
                return None
            hits = {i for _, own in automaton.iter(text) for i in own} if named else set()
            return sorted(hits.union(always))

        for texts in batches:
            yield texts.map(of, na_action=None) if len(texts) else pd.Series([], dtype=object)

    return found


def first_rule(df: DataFrame, text: Column, rules: list[tuple[list[str], str]], name: str) -> DataFrame:
    """``df`` with ``name``: the label of the first rule (keywords, label) that has a keyword in the lower-cased
    text, or null."""
    words = [(k, r) for r, (keys, _) in enumerate(rules) for k in keys]
    labels = F.array(*[F.lit(label) for _, label in rules]) if rules else F.array(F.lit(None).cast("string"))
    owner = F.array(*[F.lit(r) for _, r in words]) if words else F.array(F.lit(0))
    hits = keyword_finder([k for k, _ in words])(F.lower(text))
    return df.withColumn("_hits", hits).withColumn(
        name, F.when(F.size("_hits") > 0, F.get(labels, F.array_min(F.transform("_hits", lambda i: F.get(owner, i)))))).drop("_hits")


def matched_rules(df: DataFrame, keys: list[str], text: Column, rules: DataFrame) -> DataFrame:
    """(keys, rule_idx, keyword): every rule whose keyword is in the lower-cased text. ``rules``: (rule_idx,
    keyword), a table that fits a worker's memory (its keywords travel with the tasks)."""
    table = rules.select("rule_idx", "keyword").orderBy("rule_idx").collect()
    own = df.select(*keys, F.explode(keyword_finder([r["keyword"] for r in table])(F.lower(text))).alias("_at"))
    at = df.sparkSession.createDataFrame([(i, r["rule_idx"], r["keyword"]) for i, r in enumerate(table)] or [(-1, -1, "")],
                                         "_at int, rule_idx int, keyword string")
    return own.join(at, "_at").select(*keys, "rule_idx", "keyword")
