"""Matching functions: token overlap, ISBNs, names; Ratcliff-Obershelp similarity as an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say a title is another kind of book about the first.
MARKERS = ["workbook", "summary", "journal", "study guide", "companion", "analysis", "notebook", "calendar", "box set", "collection"]


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def isbn13_valid(c: Column) -> Column:
    digits = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda x, i: x * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(c.rlike("^[0-9]{13}$") & (total % 10 == 0), F.lit(False))


def isbn10_valid(c: Column) -> Column:
    digits = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: F.when(x == "X", 10).otherwise(x.try_cast("int")))
    total = F.aggregate(F.transform(digits, lambda x, i: x * (10 - i)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(c.rlike("^[0-9]{9}[0-9Xx]$") & (total % 11 == 0), F.lit(False))


def isbn10_to_13(c: Column) -> Column:
    """978, the first nine digits, and the new check digit; null if not valid."""
    body = F.concat(F.lit("978"), F.substring(c, 1, 9))
    digits = F.transform(F.filter(F.split(body, ""), lambda x: x != ""), lambda x: x.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda x, i: x * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return F.when(isbn10_valid(c), F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; distinct pairs of a batch are compared once."""
    from difflib import SequenceMatcher

    pairs = pd.DataFrame({"a": a.fillna(""), "b": b.fillna("")})
    uniq = pairs.drop_duplicates()
    ratio = {(x, y): SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in uniq.itertuples(index=False)}
    return pd.Series([ratio[p] for p in pairs.itertuples(index=False, name=None)], dtype=float)


def title_conflict(a: Column, b: Column) -> Column:
    """Why two titles of one block are different works: a marker word or a number that only one has, or unlike subtitles; else null."""
    la, lb = F.lower(a), F.lower(b)
    one_sided = F.lit(False)
    for m in MARKERS:
        one_sided = one_sided | (la.contains(m) != lb.contains(m))
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\b(\d{1,3})\b"), F.lit(1)))
    sub = lambda c: F.regexp_extract(c, r":\s*(.+)$", 1)
    unlike = (sub(la) != "") & (sub(lb) != "") & (jaccard(tokens(sub(la)), tokens(sub(lb))) < 0.4)
    return F.when(one_sided, "marker").when(numbers(la) != numbers(lb), "number").when(unlike, "subtitle")
