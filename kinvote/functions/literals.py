"""Word lists as SQL literals.

A list of hundreds of words becomes one parsed expression (an ``InSet`` hash lookup after
optimisation); built as Column objects each word would cost a round trip to the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quote(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def word_array(words: Iterable[str]) -> Column:
    return F.expr(f"cast(array({', '.join(map(_quote, words))}) as array<string>)")


def is_word(words: Iterable[str], value: str = "t") -> str:
    """SQL test of the lambda variable ``t`` (or an expression of it) against a word list."""
    listed = ", ".join(map(_quote, words))
    return f"{value} in ({listed})" if listed else "false"


def filter_tokens(tokens: Column, test: str) -> Column:
    return F.call_function("filter", tokens, F.expr(f"t -> {test}"))


def map_tokens(tokens: Column, value: str) -> Column:
    return F.call_function("transform", tokens, F.expr(f"t -> {value}"))
