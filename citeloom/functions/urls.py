"""URL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: hosts that are never fetched, wherever they stand in the host of a URL
SOCIAL = ("facebook.com", "twitter.com", "x.com", "github.com", "google.com", "amazon.com", "youtube.com")
# fixed values: the general entries of the deny list; longer lists come as tables (operators.pages.denied_urls)
DENIED = ("twitter.com", "x.com", "books.google.com", "docs.google.com", "youtube.com", "www.facebook.com", "music", "porn", "spotify.com", "linkedin.com", "amazon.com")


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/:?#]+)", 1)


def is_pdf(url: Column) -> Column:
    """FLT-4"""
    return F.coalesce(url.endswith(".pdf") | url.contains("/pdf/") | url.contains("/pdfs/"), F.lit(False))


def is_bad(url: Column, denied: tuple[str, ...] = DENIED) -> Column:
    """FLT-5: a denied string anywhere in the URL (the deny list is a parameter), or a PDF, or no URL."""
    hit = F.lit(False)
    for d in denied:
        hit = hit | url.contains(d)
    return F.coalesce(hit, F.lit(True)) | is_pdf(url)


def authority(url: Column) -> Column:
    """What stands between '://' and the path, with user and port, in lower case; '' without a scheme."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def admission(url: Column, denied: Column | None = None) -> Column:
    """FLT-6: 'ok' or the reason of the first rule that turns the URL away.

    denied: whether the deny list has the host as an entry (a join with a table of any size gives it); by default the entries of DENIED.
    """
    name = authority(url)
    social = F.lit(False)
    for d in SOCIAL:
        social = social | name.contains(d)
    return (
        F.when(url.isNull() | (name == ""), "invalid url")
        .when((name == "archive.org") | name.contains("internetarchive.org"), "archive")
        .when((name.isin(*DENIED) if denied is None else denied) | social, "bad domain")
        .when(name.contains("music"), "music")
        .when(F.lower(url).contains("pdf"), "pdf")
        .otherwise("ok")
    )


def page_url(page_id: Column) -> Column:
    """FLT-3"""
    return F.concat(F.lit("https://en.wikipedia.org/?curid="), page_id.cast("string"))
