"""Text functions as column expressions: slugs, titles, encodings, language, quality, roles, SEO texts."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How well-formed English reveals itself, and other languages and scraped text too.
ENGLISH_STOPWORDS = "the a an and or but in on at to for of with by from is are was were be been this that it its he she they his her their has have had not no who which will can may one all about more some than also when into".split()
FOREIGN = r"(?i)\b(el libro|traducido|vendidos|la historia|idomas|comenzado|humanidad|baños|usted|muchos|nuestra|tanggal terbit|informasi lainnya|halaman|penerbit|oleh|est un|dans le|pour les|plus de|und die|für die|buch ist)\b"
JUNK = r"(?i)goodreads\s*profile|books\s*read\s*section|description\s*not\s*available|no\s*description\s*available|description\s*is\s*being\s*reviewed|description\s*pending|description\s*coming\s*soon|placeholder\s*description|under\s*review|coming\s*soon[\s.]*$|^\s*to\s*be\s*added|^\s*tbd[\s.]*$|^\s*$"
BIO_PLACEHOLDERS = ["null", "undefined", "n/a", "na", "none", "tbd", "coming soon", "to be added", "-"]
#: Professions by keyword.
ROLE_KEYWORDS = {
    "founders": ["co-founder", "cofounder", "founder", "founding partner", "ceo", "chief executive", "chief executive officer", "cto", "coo", "cfo", "executive", "chairman", "chairwoman", "chairperson", "president", "entrepreneur", "businessman", "businesswoman", "businessperson", "business magnate", "business executive", "industrialist", "managing director", "head of product", "product manager"],
    "investors": ["investor", "angel investor", "venture capitalist", "venture capital", "vc", "hedge fund", "hedge fund manager", "fund manager", "money manager", "asset manager", "private equity", "trader", "value investor", "general partner"],
    "writers": ["author", "writer", "novelist", "journalist", "editor", "essayist", "poet", "columnist", "blogger", "reporter", "screenwriter", "playwright", "biographer", "editor-in-chief", "newsletter writer"],
    "scientists": ["scientist", "professor", "researcher", "physicist", "biologist", "neuroscientist", "psychologist", "economist", "academic", "historian", "mathematician", "philosopher", "chemist", "astronomer", "astrophysicist", "anthropologist", "sociologist", "geneticist", "computer scientist", "scholar"],
    "media": ["actor", "actress", "comedian", "broadcaster", "presenter", "television host", "talk show host", "radio host", "podcast host", "podcaster", "youtuber", "musician", "singer", "rapper", "songwriter", "athlete", "footballer", "basketball player", "baseball player", "football player", "tennis player", "boxer", "olympian", "olympic", "swimmer", "cyclist", "mixed martial artist", "film director", "filmmaker", "film producer", "model", "dj", "radio presenter", "tv presenter", "television presenter"],
    "politics": ["politician", "president of the united states", "vice president of the united states", "first lady", "senator", "prime minister", "minister", "governor", "mayor", "congressman", "congresswoman", "member of parliament", "mp", "diplomat", "ambassador", "secretary of state", "secretary of defense", "civil servant", "statesman", "stateswoman", "chancellor", "public servant", "head of state"],
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once for each row, however often use asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slugify(c: Column) -> Column:
    """Lower-case; only a-z, 0-9, blanks and hyphens; runs of the latter as one hyphen, none at the ends."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s-]+", "-"), "^-+|-+$", "")


@functools.lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """From Unicode's compatibility decompositions without combining marks: letters (and vowel signs) that become one letter, what they become (marks
    to drop follow without a partner), and letters that become several. Hangul syllables are left to a rule of their own."""
    one, many, marks = {}, {}, []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
        elif unicodedata.category(ch)[0] in "LM" and not 0xAC00 <= code <= 0xD7A3:
            flat = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
            if flat != ch:
                (one if len(flat) == 1 else many)[ch] = flat
    return "".join(one) + "".join(marks), "".join(one.values()), many


def _ranges(chars: list[str]) -> str:
    """A regular expression's class of these characters, neighbours as ranges."""
    out, codes = "", sorted(map(ord, chars))
    begin = codes[0]
    for a, b in zip(codes, [*codes[1:], -1], strict=True):
        if b != a + 1:
            out += rf"\x{{{begin:X}}}-\x{{{a:X}}}"
            begin = b
    return f"[{out}]"


def fold_accents(c: Column) -> Column:
    """Letters without their marks and in their plain forms: NFKD without combining marks, for all letters of Unicode.

    Letters that fall into several, ligatures and Hangul, are looked up one by one, and only in texts that hold any."""
    whence, to, many = _decompositions()
    # one literal, made a map while the plan is optimised
    table = F.str_to_map(F.lit("\x1e".join(f"{a}\x1f{b}" for a, b in many.items())), F.lit("\x1e"), F.lit("\x1f"))
    lead, vowel, tail = ("".join(chr(x) for x in range(a, a + n)) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def jamo(x: Column) -> Column:
        at = F.ascii(x) - 0xAC00
        pick = lambda letters, i: F.substring(F.lit(letters), i.cast("int"), F.lit(1))
        return F.concat(pick(lead, F.floor(at / 588) + 1), pick(vowel, F.floor(at % 588 / 28) + 1), F.when(at % 28 > 0, pick(tail, at % 28)).otherwise(F.lit("")))

    rare = _ranges([*many, *map(chr, (0xAC00, 0xD7A3))]) if many else "[\uAC00-\uD7A3]"
    single = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.between("\uac00", "\ud7a3"), jamo(x)).otherwise(F.coalesce(F.try_element_at(table, x), x))), "")
    return F.translate(F.when(c.rlike(rare + "|[\uAC00-\uD7A3]"), single).otherwise(c), whence, to)


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def core_title(c: Column) -> Column:
    """Up to a colon, semicolon, spaced dash or bracket; without a leading article; squashed."""
    head = F.regexp_extract(F.lower(F.trim(c)), r"^(.*?)(?:\s*[:;(\[]|\s[-–—]\s|$)", 1)
    return F.regexp_replace(F.regexp_replace(head, r"^(the|a|an)\s+", ""), "[^a-z0-9]+", "")


def surname(c: Column) -> Column:
    """The last word of the first of several names, without suffixes."""
    first = F.split(F.lower(F.trim(c)), r"\s*(?:,|&|;|\band\b)\s*").getItem(0)
    parts = F.filter(F.split(first, r"\s+"), lambda w: ~w.isin("jr", "jr.", "sr", "sr.", "ii", "iii", "iv", "phd", "md") & (w != ""))
    return F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), "[^a-z0-9]", "")


def same_work(a: Column, b: Column) -> Column:
    """Equal once squashed, or one begins with the other and the shorter has four characters or more."""
    x, y = squash(F.coalesce(a, F.lit(""))), squash(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & ((x == y) | ((F.least(F.length(x), F.length(y)) >= 4) & (x.startswith(y) | y.startswith(x))))


def repair_encoding(c: Column) -> Column:
    """_x00NN_ escapes of Windows quotes, dashes and spaces; white space runs as one blank."""
    for pattern, to in ((r"_x009[12]_", "’"), (r"_x009[34]_", '"'), (r"_x009[67]_", "—"), (r"_x0085_", "…"), (r"_x00A0_", " ")):
        c = F.regexp_replace(c, "(?i)" + pattern, to)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def repair_numeric_title(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{1,5}\.0+$"), F.regexp_extract(F.trim(c), r"^(\d{1,5})\.", 1)).otherwise(c)


def is_numeric_title(c: Column) -> Column:
    return c.rlike(r"^\s*\d{1,5}(\.\d+)?\s*$")


def likely_english(c: Column) -> Column:
    """Short texts pass; marker phrases of other languages fail; else a share of stop-words and few non-ASCII words."""
    text = F.trim(c)
    words = F.filter(F.split(F.lower(text), "[\\s,.;:!?\"']+"), lambda w: w != "")
    n = F.size(words)
    stop = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_STOPWORDS)))
    foreign = F.size(F.filter(words, lambda w: w.rlike(r"[^\x00-\x7F]")))
    judged = F.when(text.rlike(FOREIGN), False).when(n < 10, True).otherwise((stop / F.greatest(n, F.lit(1)) >= 0.1) & (foreign / F.greatest(n, F.lit(1)) <= 0.2))
    return F.when(c.isNull() | (c == ""), False).when(F.length(text) < 50, True).otherwise(judged)


def useful_description(c: Column) -> Column:
    text = F.trim(c)
    return F.coalesce((F.length(text) >= 80) & ~text.rlike(JUNK) & likely_english(text), F.lit(False))


def useful_bio(c: Column) -> Column:
    text = F.trim(c)
    return F.coalesce((F.length(text) >= 20) & ~F.lower(text).isin(*BIO_PLACEHOLDERS), F.lit(False))


def surname_alias(name: Column, *profile: Column) -> Column:
    """One word for a name and nothing of a profile."""
    blank = [F.trim(F.coalesce(p, F.lit(""))) == "" for p in profile]
    ok = (F.trim(name) != "") & ~F.trim(name).contains(" ")
    for b in blank:
        ok = ok & b
    return F.coalesce(ok, F.lit(False))


def clamp(c: Column, most: int = 700) -> Column:
    """At most `most` characters, cut at a blank if one is in the last fifth, with an ellipsis."""
    text = F.trim(c)
    cut = F.substring(text, 1, most)
    head = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(F.length(head) > most * 0.8, head).otherwise(cut), F.lit("…")))


def clean_role(c: Column) -> Column:
    """Without parentheses and punctuation at the ends; empty without three letters."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " "), r"\s+", " "))
    s = F.regexp_replace(s, r"^[;,.\-–—\s]+|[;,.\-–—\s]+$", "")
    return F.when(F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 3, s).otherwise(F.lit(""))


def classify_role(c: Column) -> Column:
    """The profession whose keyword stands first; of several at one place the longest; other without any; null without a role."""
    def first(s: Column) -> Column:
        hits = [F.struct(F.regexp_instr(s, F.lit(rf"(?i)\b\Q{w}\E\b")).alias("at"), F.lit(-len(w)).alias("len"), F.lit(bucket).alias("bucket")) for bucket, words in ROLE_KEYWORDS.items() for w in words]
        best = F.array_min(F.filter(F.array(*hits), lambda h: h["at"] > 0))
        return F.when(s != "", F.coalesce(best["bucket"], F.lit("other")))

    return once(clean_role(c), first)


def first_that_fits(most: int, *candidates: Column) -> Column:
    """The first candidate of at most `most` characters."""
    return F.get(F.filter(F.array(*candidates), lambda x: F.length(x) <= most), F.lit(0))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the characters' codes, as a bigint."""
    chars = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda h, x: ((h.bitwiseXOR(x.cast("bigint"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def parse_rating(c: Column) -> Column:
    """'3.8 (1,369)' -> struct<rating double, votes int>; a rating outside (0, 5] is null."""
    rating = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    votes = F.regexp_replace(F.regexp_extract(c, r"\(([\d,]+)\)", 1), ",", "").try_cast("int")
    return F.struct(F.when((rating > 0) & (rating <= 5), rating).alias("rating"), votes.alias("votes"))


def problem_tags(c: Column, without: Sequence[str] = ()) -> Column:
    """Tags of what is wrong with a text, in a fixed order; those in `without` are not looked for."""
    rules = (
        ("too_short", F.length(F.trim(c)) < 80), ("shouting", F.regexp_count(c, F.lit("[A-Z]")) > 0.5 * F.greatest(F.regexp_count(c, F.lit("[A-Za-z]")), F.lit(1))),
        ("table_marks", c.contains(" | ")), ("symbol_noise", c.rlike(r"[#$%&*]{3}")), ("exclamations", c.contains("!!")), ("url", c.rlike(r"https?://")), ("email", c.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+")),
        ("repeated_word", c.rlike(r"(?i)\b(\w+) \1 \1\b")), ("markup", c.rlike(r"<[a-zA-Z/][^>]*>")), ("not_english", ~likely_english(c)),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(tag)) for tag, cond in rules if tag not in without]))
