"""Small helpers for building large column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that ends words, for Java's regular expressions.
SPACES = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often and however deep in lambdas the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def blank_spaces(text: Column) -> Column:
    """The text with a blank for each character of white space."""
    for c in "\t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def paired(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` over ``a`` and ``b``, as far as ``b`` goes."""
    return F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, f)


def later(x: Column, by: int) -> Column:
    """The array without its first ``by`` elements."""
    return F.slice(x, F.lit(by + 1), F.greatest(F.size(x) - by, F.lit(0)))


def upto(n: Column) -> Column:
    """0 .. n-1; empty for n < 1 (a plain sequence would run backwards)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
