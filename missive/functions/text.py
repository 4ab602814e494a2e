"""Scalar expressions on text that several operators share."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no value.
ARTICLES = ("the", "a", "an")


@functools.cache
def marked() -> tuple[str, str]:
    """Lower-case characters that decompose into another one and marks above, below or in it, and those others."""
    parts = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0x80, 0x20000)) if c == c.lower()]
    found = [(c, d[0]) for c, d in parts if len(d) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def folded(text: Column) -> Column:
    """Lower case without diacritics, whether they are composed or marks of their own."""
    return F.regexp_replace(F.translate(F.lower(text), *marked()), r"\p{Mn}+", "")


@functools.cache
def _unmark() -> dict[int, int]:
    return str.maketrans(*marked())


def fold(text: str) -> str:
    """``folded`` for a Python text."""
    if text.isascii():
        return text.lower()
    plain = text.lower().translate(_unmark())
    return "".join(c for c in plain if unicodedata.category(c) != "Mn")


def words(text: Column) -> Column:
    """Words of letters and digits in order, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility forms (ligatures, full width, superscripts) as plain characters."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(text: Column) -> Column:
    """``text`` in NFKC. Texts of ASCII, which are so already, reach Python as nulls."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def value_words(value: Column) -> Column:
    """The words of a value (``compatible``, where it may not be ASCII): lower case, letters and digits only, without articles."""
    plain = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(*ARTICLES))


def value_key(value: Column) -> Column:
    return F.array_join(value_words(value), " ")


def similar(ka: Column, kb: Column) -> Column:
    """One value key of three characters or more inside the other, or half of all words shared."""
    inside = (F.length(ka) >= 3) & (F.length(kb) >= 3) & (F.contains(ka, kb) | F.contains(kb, ka))
    wa, wb = F.split(ka, " "), F.split(kb, " ")
    union = F.size(F.array_union(wa, wb))
    return inside | ((union > 0) & (2 * F.size(F.array_intersect(wa, wb)) >= union))
