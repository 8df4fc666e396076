"""DuckDB SQL fragments mirroring trendspark.functions (oracle side only)."""

from __future__ import annotations

from trendspark.functions.text import WS


def clean_alpha(e: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce(CAST({e} AS VARCHAR), 'None')), "
            f"'[^a-z{WS}]', '', 'g'), '[{WS}]+', ' ', 'g'))")


def clean_alnum(e: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce(CAST({e} AS VARCHAR), 'None')), "
            f"'[^a-z0-9{WS}]', '', 'g'), '[{WS}]+', ' ', 'g'))")


def tokens(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


def bigrams(t: str) -> str:
    return (f"(CASE WHEN len({t}) < 2 THEN CAST([] AS VARCHAR[]) ELSE "
            f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]) END)")


def richness(t: str) -> str:
    return f"(len(list_distinct({t})) / (len({t}) + 1))"


def raw_word_count(e: str) -> str:
    return f"len(list_filter(regexp_split_to_array({e}, '[{WS}]+'), lambda x: x <> ''))"


def stop_filter(t: str, stops_sql: str) -> str:
    return f"list_filter({t}, lambda x: NOT list_contains({stops_sql}, x))"
