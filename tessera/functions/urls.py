"""URL functions as column expressions: hosts, clean forms, product ids, source kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once

#: Hosts by the kind of page they carry.
YOUTUBE_HOSTS = ["youtube.com", "youtu.be", "m.youtube.com"]
PODCAST_HOSTS = ["tim.blog", "podcasts.apple.com", "overcast.fm", "pca.st", "pocketcasts.com", "podbay.fm", "castbox.fm", "podcasts.google.com", "stitcher.com", "lexfridman.com", "joincolossus.com", "investorfieldguide.com", "hubermanlab.com", "peterattiamd.com", "jrelibrary.com", "podscripts.co", "happyscribe.com"]
OTHER_HOSTS = ["wikipedia.org", "wikiquote.org", "instagram.com", "facebook.com", "reddit.com", "quora.com", "pinterest.com", "tiktok.com"]
UNVETTED_HOSTS = ["twitter.com", "x.com", "t.co", "instagram.com", "facebook.com", "fb.com", "tiktok.com", "linkedin.com", "lnkd.in", "reddit.com", "quora.com", "pinterest.com", "goodreads.com", "bit.ly", "tinyurl.com", "ow.ly", "buff.ly"]
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|source)"


def host_of(url: Column) -> Column:
    """Lower-case host without www. and port; null without a scheme."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def on_host(host: Column, bases: list[str]) -> Column:
    """The host is one of the bases or below one."""
    return F.coalesce(host.rlike(r"(^|\.)(" + "|".join(b.replace(".", r"\.") for b in bases) + ")$"), F.lit(False))


def clean_url(url: Column) -> Column:
    """Without fragment, tracking parameters and closing slash; the host lower-case."""
    base = F.regexp_replace(F.trim(url), "#.*$", "")
    base = F.regexp_replace(base, rf"([?&]){TRACKING}=[^&]*(?=&|$)", "$1")
    base = F.regexp_replace(F.regexp_replace(base, r"\?&+", "?"), r"&+(?=&|$)", "")
    base = F.regexp_replace(F.regexp_replace(base, r"[?&]+$", ""), "/+$", "")
    head = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substr(base, F.length(head) + 1))


def is_store(url: Column) -> Column:
    """A shop page or short link of the large bookseller."""
    host = host_of(url)
    return F.coalesce(host.rlike(r"(^|\.)amazon(\.[a-z]{2,3}){1,2}$") | host.isin("amzn.to", "amzn.com", "a.co"), F.lit(False))


def product_id(url: Column) -> Column:
    """The 10-character product id in /dp/ or /gp/product/, upper-case; of 22 characters the first 10; else null."""
    raw = F.regexp_extract(url, r"/(?:dp|gp/product)/([^/?#]+)", 1)
    fits = raw.rlike("^[A-Za-z0-9]{10}$") | ((F.length(raw) == 22) & raw.rlike("^[A-Za-z0-9]{10}"))
    return F.when(fits, F.upper(F.substring(raw, 1, 10)))


def tweet_handle(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://(?:www\.|mobile\.)?(?:twitter|x)\.com/([^/?#]+)/status", 1)), F.lit(""))


def outbound_rel(url: Column) -> Column:
    """What a link's rel says: paid for, not vouched for, or nothing."""
    return F.when(is_store(url), "nofollow sponsored").when(on_host(host_of(url), UNVETTED_HOSTS), "nofollow").otherwise("")


def snowflake_year(url: Column) -> Column:
    """The year of a post from its id (ids above 2**32 carry their time), else a /YYYY/ in the path; null without either."""
    post = F.regexp_extract(url, r"/status/(\d{1,19})", 1).try_cast("bigint")
    at = F.timestamp_millis(F.shiftright(post, 22) + 1288834974657)
    return F.when(post > (1 << 32), F.year(at)).otherwise(F.regexp_extract(url, r"/((?:19|20)\d\d)/", 1).try_cast("int"))


def split_urls(c: Column) -> Column:
    """The distinct web addresses in a field that joins several by pipes, commas or nothing; those of the web archive stay whole."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(https?):/(?!/)", "$1://")
    parts = F.split(text, r"\s*\|\s*|,(?:%20|\s)*(?=https?://)")
    parts = F.flatten(F.transform(parts, lambda p: F.when(p.contains("web.archive.org"), F.array(p)).otherwise(F.split(p, r"(?<=.)(?=https?://)"))))
    parts = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"[,;\s]+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^https?://[^\s/.]+\.[^\s]+$")))


def source_kind(url: Column, slug: Column, name: Column, handle: Column) -> Column:
    """struct<kind, own>: tweet, youtube, own_site, podcast, other or article, and whether the page is the person's own."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    facts = F.struct(
        host_of(url).alias("host"), F.lower(path_of(url)).alias("path"), tweet_handle(url).alias("tweeter"), F.lower(F.regexp_replace(F.trim(F.coalesce(handle, F.lit(""))), "^@", "")).alias("known"),
        flat(slug).alias("slug"), flat(name).alias("name"), flat(F.element_at(F.split(F.trim(name), r"\s+"), -1)).alias("last"),
    )

    def of(x: Column) -> Column:
        host, path, tweeter, slug, name, last = (x[c] for c in ("host", "path", "tweeter", "slug", "name", "last"))
        theirs = F.when(x["known"] != "", tweeter == x["known"]).otherwise(once(flat(tweeter), lambda t: (F.length(t) >= 4) & ((t == slug) | (t == name))))
        at = once(flat(host), lambda h: ((F.length(name) >= 6) & h.contains(name)) | ((F.length(slug) >= 6) & h.contains(slug)))
        carries = at | ((F.length(last) >= 5) & flat(F.split(host, r"\.").getItem(0)).contains(last))
        podcast = on_host(host, PODCAST_HOSTS) | path.rlike(r"(^|[/\-_.])(podcast|podcasts|episode|episodes|ep)([/\-_.]|\d|$)") | host.contains("podcast") | (on_host(host, ["open.spotify.com"]) & path.rlike("/(episode|show)/"))
        kind = F.when(host.isNull(), "other").when(tweeter.isNotNull(), "tweet").when(on_host(host, YOUTUBE_HOSTS), "youtube").when(carries, "own_site").when(podcast, "podcast").when(on_host(host, [*OTHER_HOSTS]) | host.isin("twitter.com", "x.com"), "other").otherwise("article")
        return once(kind, lambda k: F.struct(k.alias("kind"), F.coalesce(F.when(k == "tweet", theirs).otherwise(k == "own_site"), F.lit(False)).alias("own")))

    return once(facts, of)
