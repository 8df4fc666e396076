"""Stop lists: Spark ML's English list united with the news-domain list."""

from __future__ import annotations

import functools

from trendspark.rules import ENGLISH_STOPS, NEWS_DOMAIN_STOPS


def spark_english_stop_words() -> tuple[str, ...]:
    """The words of ``StopWordsRemover.loadDefaultStopWords('english')`` as a plain
    list, so that neither a JVM nor a file is touched when modules load."""
    return tuple(ENGLISH_STOPS)


@functools.lru_cache(maxsize=None)
def all_stops() -> tuple[str, ...]:
    """Union of the base list and the news-domain list, distinct, sorted."""
    return tuple(sorted(set(ENGLISH_STOPS) | set(NEWS_DOMAIN_STOPS)))


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
