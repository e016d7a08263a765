"""Description hygiene: what is wrong with a text, the strips that are safe, repeated until nothing changes, and what to do then."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of placeholders, marketing and damage, in the order of their tags; words that begin prose; names in mixed case.
PLACEHOLDER = r"(?i)\bfor use in schools and libraries only\b|\bdescription is being reviewed\b|\bno description available\b"
BULLET_RUN = r"^(?:\s*\*\s*[^*\n]{3,200}){2,}"
LEADING_STARS = r"^[\s ]*\*+"
WSJ = r"(?i)\binstant wsj bestseller\b"
NYT = r"(?i)\bnew york times (?:#?\d+\s*)?bestseller\b"
STAR_BLOB = r"\*{3,}"
PRAISE = r"(?i)\bpraise for [^:]{1,80}:"
MASHED = r"\b[A-Za-z]*[a-z][A-Z][a-z]+[A-Za-z]*\b"
MASHED_KNOWN = ["iphone", "ipad", "imac", "ipod", "macbook", "youtube", "linkedin", "wikipedia", "javascript", "typescript", "github", "gitlab", "openai", "deepmind", "deepseek", "bigquery", "postgresql", "mysql", "mongodb", "nodejs", "graphql", "ebay", "powerpoint", "wordpress", "tiktok", "snapchat", "whatsapp", "facetime", "airpods", "airdrop", "facebook", "instagram", "harpercollins", "simonschuster", "penguinrandomhouse"]
TAGS = [
    ("placeholder_text", PLACEHOLDER), ("leading_asterisks", LEADING_STARS), ("inline_asterisk_blob", STAR_BLOB), ("asterisk_bullet_run", BULLET_RUN), ("award_marketing_wsj", WSJ),
    ("anniversary_edition_metadata", r"(?i)\b\d{1,3}(?:st|nd|rd|th)?\s+anniversary edition\b"), ("edition_includes_metadata", r"(?i)\b(?:edition includes|includes exclusive bonus material)\b"), ("intro_metadata", r"(?i)\bwith an introduction by\b"),
    ("nyt_bestseller_noisy", NYT), ("trailing_praise_block", PRAISE), ("trailing_trilogy_continue", r"(?i)\bcontinue [A-Z][^.]{5,200}\.\s*$"), ("mojibake_question_marks", r"\?[A-Za-z]"), ("missing_space_after_period", r"[a-z]\.[A-Z][a-z]"),
    ("mashed_words", MASHED), ("leading_catalog_book_n", r"(?i)^\s*book\s+\d+[\.\,]?\s+"), ("leading_second_edition", r"(?i)^\s*second edition[\.\,]?\s+"),
]
QUOTES = "‘’“”\"'"
PROSE = r"(?:This|These|Those|That|A|An|It|It['’]s|At|When|Where|Set|Following|Why|How|What|If|Imagine|After|Before|Then|Once|While|During|Through|Across|Over|Now|Despite|Against|Above|Below|Until|Although|Though|Even|Yet|Still|There|Here|His|Her|Their|Our|My)"
BLURB = rf"^\s*[{QUOTES}][^{QUOTES}]{{2,80}}[{QUOTES}][\s\.\,\-–—A-Za-z'’‘&]{{0,80}}?\s+"
BANNER = r"^\s*\*{1,3}\s*[A-Z][A-Z0-9 '\-:&]{7,200}\s*\*{1,3}\s+"
ANNIVERSARY = r"(?i)^\s*This\s+\d{1,3}(?:st|nd|rd|th)?\s+Anniversary Edition[^.]{0,400}?\.\s+"
SCHOOLS = r"(?i)^\s*for use in schools and libraries only\.\s+"
PRAISE_TAIL = r"(?is)\s*Praise for [^:]{1,80}:.*$"
CONTINUE_TAIL = r"\s*Continue [A-Z][^.]{5,300}\.\s*$"
RESTART = r"[\.\?!]\s+[A-Z]"
UNFIXABLE = ["mojibake_question_marks", "missing_space_after_period", "mashed_words", "leading_title_repetition", "leading_catalog_book_n", "leading_second_edition"]
SURE = ["placeholder_text", "leading_asterisks", "asterisk_bullet_run", "inline_asterisk_blob", "anniversary_edition_metadata", "edition_includes_metadata", "trailing_praise_block", "trailing_trilogy_continue", "award_marketing_wsj"]
LEFTOVER = rf"^(?:[a-z]|Recommended by|Translated into|Instant WSJ|An Amazon|#\d|National Bestseller|National \#?1|Now a (?:major )?motion picture|Anniversary Edition|Includes exclusive|With an introduction|Praise for|Sheer |Magical |One of the world|[{QUOTES}]|(?:[A-Z][A-Z0-9'\-]*\s+){{4,}}[A-Z][A-Z0-9'\-]*|[*/+\-_=])"
PASSES = 6


def problems(text: Column, title: Column | None = None) -> Column:
    """Tags of what is wrong with a description, in a fixed order; empty_description alone for nothing at all."""
    s = F.coalesce(text, F.lit(""))
    holds = {tag: s.rlike(pattern) for tag, pattern in TAGS}
    holds["nyt_bestseller_noisy"] = holds["nyt_bestseller_noisy"] & (holds["asterisk_bullet_run"] | holds["leading_asterisks"] | holds["award_marketing_wsj"])
    # damage counts from several places on
    holds["mojibake_question_marks"] = F.regexp_count(s, F.lit(r"\?[A-Za-z]")) >= 3
    holds["mashed_words"] = F.size(F.filter(F.regexp_extract_all(s, F.lit(f"({MASHED})"), F.lit(1)), lambda w: ~F.lower(w).isin(MASHED_KNOWN))) >= 2
    tags = [F.when(cond, F.lit(tag)) for tag, cond in holds.items()]
    if title is not None:
        t = F.trim(F.coalesce(title, F.lit("")))
        head = F.regexp_replace(s, r"^\s+", "")
        repeated = (t != "") & F.lower(head).startswith(F.lower(t)) & F.substr(head, F.length(t) + 1).rlike(r"(?i)^\s+(?:is\s+|,\s+|:|by\s+)")
        tags.append(F.when(repeated, F.lit("leading_title_repetition")))
    return F.when(s.rlike(r"^\s*$"), F.array(F.lit("empty_description"))).otherwise(F.array_compact(F.array(*tags)))


def _without_bullets(s: Column) -> Column:
    """Without leading bullets, unless one of them runs into prose."""
    chunks = F.filter(F.slice(F.split(s, r"\s*\*\s*"), 2, 1 << 30), lambda c: ~c.rlike(r"^\s*$"))
    prose = F.exists(chunks, lambda c: (F.length(c) >= 200) | c.rlike(RESTART))
    return F.when(s.rlike(r"^\s*\*") & (F.size(chunks) > 0) & ~prose, F.lit("")).otherwise(s)


def stripped(s: Column) -> Column:
    """One pass of every safe strip."""
    s = F.regexp_replace(F.regexp_replace(s, SCHOOLS, ""), BANNER, "")
    s = F.regexp_replace(s, rf"{BLURB}(?={PROSE}\b)", "")
    s = _without_bullets(F.regexp_replace(s, ANNIVERSARY, ""))
    s = F.regexp_replace(F.regexp_replace(s, STAR_BLOB, " "), PRAISE_TAIL, "")
    s = F.regexp_replace(F.regexp_replace(s, CONTINUE_TAIL, ""), r"^[\s*]+", "")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^ | $", "")


def cleaned(text: Column, most: int = PASSES) -> Column:
    """struct<text, passes, trace>: the strips repeated until a pass changes nothing, `most` times at most; passes counts those that
    changed the text, trace has the length after each. What nothing changes is left as it came."""
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("passes"), F.array().cast("array<int>").alias("trace"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        # the new text is worked out once, in an array of one, and read from there
        new = F.transform(F.array(stripped(state["text"])), lambda x: F.when(x == state["text"], F.struct(state["text"].alias("text"), state["passes"].alias("passes"), state["trace"].alias("trace"), F.lit(True).alias("done"))).otherwise(
            F.struct(x.alias("text"), (state["passes"] + 1).alias("passes"), F.concat(state["trace"], F.array(F.length(x))).alias("trace"), F.lit(False).alias("done"))))
        return F.when(state["done"], state).otherwise(F.element_at(new, 1))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return F.struct(end["text"].alias("text"), end["passes"].alias("passes"), end["trace"].alias("trace"))


def evaluated(text: Column, clean: Column, tags: Column) -> Column:
    """struct<action, confidence>: would_clean (high or medium), needs_manual_review (low) or skip, from a text, its clean form and its tags."""
    unsafe = clean.rlike(r"\?[A-Za-z]") | clean.rlike(r"[a-z]\.[A-Z][a-z]") | clean.rlike(LEFTOVER)
    review = (
        F.array_contains(tags, "empty_description") | F.arrays_overlap(tags, F.array(*map(F.lit, UNFIXABLE))) | (clean == F.regexp_replace(text, r"^\s+|\s+$", "")) | (clean == text) | (F.length(clean) < 100)
        | (F.array_contains(tags, "placeholder_text") & clean.rlike(PLACEHOLDER)) | unsafe
    )
    high = F.arrays_overlap(tags, F.array(*map(F.lit, SURE))) & (F.length(clean) >= 200)
    action = F.when(F.size(tags) == 0, "skip").when(F.coalesce(review, F.lit(True)), "needs_manual_review").otherwise("would_clean")
    confidence = F.when(F.size(tags) == 0, "").when(F.coalesce(review, F.lit(True)), "low").when(high, "high").otherwise("medium")
    return F.struct(action.alias("action"), confidence.alias("confidence"))
