"""Editorial fields: lists in many shapes, titles for display, covers, themes, reading levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short items that are words of their own, words kept small in titles, and acronyms.
ACRONYM_ITEMS = ["CEO", "CFO", "CTO", "COO", "CIA", "FBI", "AI", "API", "DNA", "UX", "UI", "ML", "MIT", "NSA", "PM", "CMO", "VP", "HR", "PR", "QA", "VC", "MBA", "PHD"]
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "nor", "for", "of", "to", "in", "on", "at", "with", "by", "from", "as", "vs"]
ACRONYMS = ["CEO", "CFO", "CTO", "COO", "CIA", "FBI", "AI", "API", "DNA", "UX", "UI"]


def editorial_list(c: Column, most: int = 4, least: int = 8) -> Column:
    """Items of a field that may be a JSON array, or joined by pipes, lines or (if all parts are long enough) semicolons.

    Bullets, numbers and quotes around items go, short ones but acronyms too, repeats once; of single letters nothing is left."""
    s = F.trim(F.coalesce(c, F.lit("")))
    json = F.filter(F.from_json(F.when(s.startswith("["), s), "array<string>"), lambda x: x.isNotNull())
    semi = F.filter(F.transform(F.split(s, ";"), lambda x: F.trim(x)), lambda x: x != "")
    items = (
        F.when(F.size(json) > 0, json).when(s.contains("|"), F.split(s, r"\|")).when(s.contains("\n"), F.split(s, "\r?\n"))
        .when((F.size(semi) >= 2) & F.forall(semi, lambda x: F.length(x) >= least), semi).otherwise(F.array(s))
    )

    def tidy(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), r"^[\-•–—*]+\s*", "")
        x = F.regexp_replace(x, r"^\d+[.)]\s*", "")
        return F.trim(F.regexp_replace(x, r'^["“]+|["”]+$', ""))

    kept = F.filter(F.transform(items, tidy), lambda x: (x != "") & ((F.length(x) >= least) | F.upper(x).isin(*ACRONYM_ITEMS)))
    first = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.slice(first, 1, most)


def title_case(c: Column) -> Column:
    """Small words of a title in title case become small, but for the first, the last and those after a colon or dash; other titles stay."""
    s = F.trim(F.coalesce(c, F.lit("")))
    words = F.split(s, r"\s+")
    cased = F.forall(words, lambda w: ~F.regexp_extract(w, "([A-Za-z])", 1).rlike("[a-z]"))
    n = F.size(words)
    out = F.transform(words, lambda w, i: F.when(F.upper(w).isin(*ACRONYMS), F.upper(w)).when((i > 0) & (i < n - 1) & F.lower(w).isin(*SMALL_WORDS) & ~F.get(words, i - 1).rlike("[:?!—–-]$"), F.lower(w)).otherwise(w))
    return F.when((n < 2) | ~cased, s).otherwise(F.array_join(out, " "))


def display_title(c: Column) -> Column:
    """A slug as words with capitals; anything else as it is."""
    words = F.transform(F.split(c, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(c.rlike("(?i)^[a-z0-9]+(-[a-z0-9]+)+$"), F.array_join(words, " ")).otherwise(F.coalesce(c, F.lit("")))


def list_kind(slug: Column) -> Column:
    s = F.lower(F.coalesce(slug, F.lit("")))
    return F.when(s == "", "other").when(s == "most-recommended-books", "meta").when(s.endswith("-in-order") | s.contains("books-in-order"), "other").when(s.startswith("best-"), "topic").otherwise("category")


def missing_cover(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ~low.rlike("^https?://") | low.rlike(r"placeholder|no[-_]?cover|default[-_]?cover|nophoto")


def mashed_tokens(c: Column) -> Column:
    """Words with a capital after a small letter inside, but for name prefixes."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"\b([A-Za-z]*[a-z][A-Z][A-Za-z]*)\b"), F.lit(1)), lambda w: ~w.rlike("^(?:Mc|Mac|De|Di|La|Le|Van|Von|O)[A-Z][a-z]+$|^i[A-Z]"))


def weak_theme(c: Column) -> Column:
    """Too long, unfinished, or a sentence rather than a theme."""
    t = F.trim(c)
    return (F.size(F.split(t, r"\s+")) > 10) | t.endswith("...") | t.endswith("…") | t.rlike(r"(?i)^(?:this|it|the book|a book|how the author)\b") | (t == "")


def difficulty(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike(r"\b(academic|technical|dense|advanced|graduate)\b"), "hard").when(low.rlike(r"\b(beginner|easy|accessible|introduct\w*|children)\b"), "easy").otherwise("medium")
