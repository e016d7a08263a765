"""Curation rules as columns: categories, candidate scores, descriptions, numbers for display, names, licences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of several words (looked up without spaces and hyphens), spellings mended, and parents.
MULTIWORD = ["Science Fiction", "Self-Help", "Personal Development", "Historical Fiction", "True Crime", "Graphic Novels", "Social Sciences", "American History"]
MENDED = {"biz": "Business", "sci-fi": "Science Fiction", "memoirs": "Memoir"}
PARENTS = {"Fiction": ["Fiction", "Science Fiction", "Historical Fiction", "Graphic Novels", "Fantasy"], "Nonfiction": ["Business", "Self-Help", "Personal Development", "True Crime", "Social Sciences", "American History", "Memoir", "History"], "Cross-cut": ["Children's", "Teen & Young Adult", "Adult", "LGBTQ"]}


def folded(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug_with_and(c: Column) -> Column:
    """A slug in which & is a word and apostrophes leave no gap."""
    s = F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit(" and ")), "['’`]", "")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", "-"), F.lit("-"))


def categories(raw: Column) -> Column:
    """Clean categories of a field: cut at commas, bullets and dots; in glued words the known phrases come first, then each
    change from small to capital letter; repeats (in any case) once, in order of appearance."""
    marked = raw
    for phrase in sorted(MULTIWORD, key=lambda p: (-len(p), p)):
        # a phrase found is fenced, and its letters are hidden from the cuts and from shorter phrases by its number
        marked = F.regexp_replace(marked, f"(?i){re.sub('[ -]', '[ -]?', phrase)}", f"\x1f\x1e{MULTIWORD.index(phrase)}\x1f")
    marked = F.regexp_replace(marked, "LGBTQ(?=[A-Z])", "LGBTQ\x1f")
    parts = F.split(F.regexp_replace(marked, "(?<=[a-z])(?=[A-Z])", "\x1f"), "[,•.\x1f]")
    known = F.array(*map(F.lit, MULTIWORD))
    mended = F.create_map(*[F.lit(x) for kv in MENDED.items() for x in kv])

    def tidy(p: Column) -> Column:
        p = F.trim(F.regexp_replace(p, r"\s+", " "))
        return F.when(p.startswith("\x1e"), F.get(known, F.substring(p, 2, 2).try_cast("int"))).when(F.length(p) >= 2, F.coalesce(F.element_at(mended, F.lower(p)), p))

    clean = F.array_compact(F.transform(parts, tidy))
    lower = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def parent_of(category: Column) -> Column:
    out = F.lit("Other")
    for parent, own in PARENTS.items():
        out = F.when(category.isin(own), parent).otherwise(out)
    return out


def score_parts(title: Column, author: Column) -> Column:
    """struct<t, core, a, last>: what candidates are compared by, worked out once for each side."""
    core, a = folded(F.regexp_replace(title, r"\s*[:;(\[].*$", "")), folded(F.coalesce(author, F.lit("")))
    return F.struct(folded(title).alias("t"), core.alias("core"), a.alias("a"), F.element_at(F.split(a, " "), -1).alias("last"))


def score_of(x: Column, y: Column, isbn: Column) -> Column:
    """struct(score, method): how surely a candidate y is the book x (both score_parts), from 1.00 (its number) down to 0.15."""
    full, same = (x["t"] != "") & (x["t"] == y["t"]), (x["core"] != "") & (x["core"] == y["core"])
    part = (x["t"] != "") & (y["t"] != "") & (y["t"].contains(x["t"]) | x["t"].contains(y["t"]))
    whole, by, unsigned = (x["a"] != "") & (x["a"] == y["a"]), (F.length(x["last"]) >= 4) & ((x["last"] == y["a"]) | (x["last"] == y["last"])), y["a"] == ""
    ladder = [
        (isbn, 1.0, "isbn"), (full & whole, 0.97, "full+author"), (same & whole, 0.93, "core+author"), (full & by, 0.9, "full+last"), (same & by, 0.87, "core+last"), (full & unsigned, 0.65, "full"),
        (same & ~unsigned & ~by, 0.4, "core+mismatch"), (part & by, 0.55, "part+last"), (part & unsigned, 0.3, "part"), (same, 0.5, "core"),
    ]
    found = F.struct(F.lit(0.15).alias("score"), F.lit("fuzzy").alias("method"))
    for cond, s, name in reversed(ladder):
        found = F.when(cond, F.struct(F.lit(s).alias("score"), F.lit(name).alias("method"))).otherwise(found)
    return found


def candidate_score(title: Column, author: Column, other_title: Column, other_author: Column, isbn: Column) -> Column:
    """score_of two titles and authors as they are written."""
    return score_of(score_parts(title, author), score_parts(other_title, other_author), isbn)


def year_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) > 3, F.lit(False))


#: What junk descriptions begin with or hold.
QUOTE_LINE = r'^\s*"[^"]+"\s*[-–—]'
BLURB = r'^\s*"[^"]*"\s*$'
RECOMMENDS = r"(?i)\b(?:recommended by|bestselling author of|must[- ]read)\b"
DECENT, CANDIDATE, SURE = 80, 120, 0.87


def description_state(c: Column) -> Column:
    """struct(state, why) of a description: empty, junk (with every reason) or decent."""
    s = F.trim(c)
    why = F.array_join(F.array_compact(F.array(F.when(s.rlike(QUOTE_LINE), "quote_attribution"), F.when(s.rlike(BLURB), "blurb_only"), F.when(s.rlike(RECOMMENDS), "recommendation"), F.when(F.length(s) < DECENT, "too_short"))), ",")
    return F.struct(F.when(c.isNull() | (s == ""), "empty").when(why != "", "junk").otherwise("decent").alias("state"), F.when(c.isNull(), "null").when(s == "", "blank").otherwise(why).alias("why"))


def description_flags(c: Column) -> Column:
    """Every concern about a description offered instead, joined; empty if none."""
    s = F.coalesce(c, F.lit(""))
    flags = F.array(F.when(F.length(s) < CANDIDATE, "too_short"), F.when(s.rlike(BLURB), "blurb"), F.when(s.rlike(r"(?i)https?://|www\."), "address"), F.when(s.rlike(r"<[a-zA-Z/][^>]*>"), "markup"), F.when(F.ltrim(s).startswith("*"), "asterisks"))
    return F.when(s == "", "empty").otherwise(F.array_join(F.array_compact(flags), ","))


def description_action(score: Column, flags: Column, state: Column) -> Column:
    return F.when((score >= SURE) & (flags == "") & state.isin("empty", "junk"), "would_backfill").when(state == "decent", "skip").otherwise("manual_review")


#: Exact replacements for artifacts of conversion, and what then still needs a look.
REPLACED = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), (" ,", ","), (" .", "."), ("..", "."), ("  ", " "), ("<br>", " ")]
RESIDUAL = r"&[a-z]+;|&#\d+;|<[a-z/][^>]*>|\{\{|\}\}|\\u[0-9a-f]{4}"


def artifacts_replaced(c: Column) -> Column:
    for old, new in REPLACED:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def display_rating(c: Column) -> Column:
    return F.when((c >= 1) & (c <= 5), F.floor(c * 10 + 0.5) / 10)


def display_confidence(c: Column) -> Column:
    """A share or a number up to 100 as a percentage; nothing else is shown."""
    return F.when((c > 0) & (c <= 1), F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))).when((c > 1) & (c <= 100), F.concat(F.floor(c + 0.5).cast("string"), F.lit("%")))


def own_source(urls: Column, handle: Column) -> Column:
    """Whether an address may be the person's own: any but posts, or a post of the known handle; without a handle any."""
    parts = F.filter(F.transform(F.split(F.coalesce(urls, F.lit("")), r"\|"), lambda u: F.trim(u)), lambda u: u != "")
    posts = F.filter(parts, lambda u: u.rlike(r"(?i)(?:twitter|x)\.com/[^/]+/status"))
    h = F.lower(F.regexp_replace(F.coalesce(handle, F.lit("")), "^@", ""))
    return F.when(F.size(parts) == 0, False).when((h == "") | (F.size(posts) != F.size(parts)), True).otherwise(F.exists(posts, lambda u: F.lower(u).contains(F.concat(F.lit("/"), h, F.lit("/status")))))


def same_person(page: Column, ours: Column) -> Column:
    """Names equal without marks, or ours only adds names between the first and the last."""
    p, o = F.split(folded(page), " "), F.split(folded(ours), " ")
    between = (F.size(p) >= 2) & (F.size(o) > F.size(p)) & (F.get(p, F.lit(0)) == F.get(o, F.lit(0))) & (F.element_at(p, -1) == F.element_at(o, -1)) & (F.size(F.array_except(p, o)) == 0)
    return (folded(page) != "") & ((F.replace(folded(page), F.lit(" "), F.lit("")) == F.replace(folded(ours), F.lit(" "), F.lit(""))) | between)


LABEL = r"(?i)\(\s*\d+\s*books?\s*\)|\bbooks?\)$|^(?:book recommendations|reading list|list of\b|books? for|recommendations? from)\b|\b(?:newsletter|subreddit|website)\b|\bblog$"


def name_leak(text: Column, name: Column) -> Column:
    """Whether a text holds a part (four letters or more) of a name as a word; labels that are no names do not count."""
    parts = F.filter(F.split(F.lower(name), "[^a-z]+"), lambda w: F.length(w) >= 4)
    words = F.split(F.lower(text), "[^a-z]+")
    return ~name.rlike(LABEL) & F.arrays_overlap(parts, words)


def licence_ok(c: Column) -> Column:
    """Free to show: nothing that forbids it, and one of the free kinds by name."""
    return ~c.rlike(r"(?i)\bnc\b|noncommercial|\bnd\b|noderiv|fair use|all rights") & c.rlike(r"(?i)\bcc0\b|public domain|\bcc[ -]by\b|\bpd\b")


def photo_credit(author: Column, licence: Column) -> Column:
    return F.when(F.coalesce(licence, F.lit("")) == "", F.lit(None)).otherwise(F.concat(F.lit("Photo: "), F.coalesce(F.nullif(F.trim(author), F.lit("")), F.lit("unknown author")), F.lit(" ("), licence, F.lit(")")))


def thumbnail(url: Column, width: int) -> Column:
    """The address of a smaller copy of a shared image; other addresses stay."""
    return F.regexp_replace(url, r"^(https://upload\.wikimedia\.org/wikipedia/commons)/([0-9a-f]/[0-9a-f]{2})/([^/]+)$", rf"$1/thumb/$2/$3/{width}px-$3")


def first_fitting(most: int, *texts: Column) -> Column:
    """The first of several texts that has at most `most` characters."""
    return F.get(F.filter(F.array(*texts), lambda t: F.length(t) <= most), F.lit(0))


def lens_distance(r: Column, s: Column, area: Column, rounds: int = 40) -> Column:
    """How far apart two circles stand that share `area`, by halving between r + s and |r - s|."""
    def shared(d: Column) -> Column:
        a = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d * d + r * r - s * s) / (2 * d * r))))
        b = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d * d + s * s - r * r) / (2 * d * s))))
        return r * r * (a - F.sin(2 * a) / 2) + s * s * (b - F.sin(2 * b) / 2)

    def step(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        return F.struct(F.when(shared(mid) > area, mid).otherwise(state["lo"]).alias("lo"), F.when(shared(mid) > area, state["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct((F.abs(r - s) + 1e-9).alias("lo"), (r + s).cast("double").alias("hi")), step)
    return (end["lo"] + end["hi"]) / 2
