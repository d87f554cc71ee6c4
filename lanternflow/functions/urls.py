"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSETS = r"\.(jpg|png|gif|zip)$"


def url_host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment; empty for what is no URL."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def link_kind(url: Column, content_type: Column | None = None) -> Column:
    pdf = F.lower(url_path(url)).endswith(".pdf")
    if content_type is not None:
        pdf = pdf | F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf")
    return F.when(pdf, F.lit("pdf")).otherwise(F.lit("html"))


def is_asset(url: Column) -> Column:
    return F.lower(url_path(url)).rlike(ASSETS)


def host_twin(host: Column) -> Column:
    """The same host with or without a leading www."""
    return F.when(host.startswith("www."), F.substring(host, 5, 10_000)).otherwise(F.concat(F.lit("www."), host))


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL from a link and the page that holds it; null for mailto:, tel:, javascript: and the like.

    Handles full, scheme-relative, root-relative, query-only, fragment-only and path-relative links, and removes
    ./ and ../ steps.
    """
    href = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.concat(site, F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(url_path(base), "^/", "")), r"[^/]*$", ""))
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(plain, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href == "", base)
        .otherwise(F.concat(folder, href))
    )
    return without_dots(joined)


def without_dots(url: Column) -> Column:
    """The URL without ./ and ../ steps in its path, however many; steps above the root are dropped."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"
    site, path, rest = (F.regexp_extract(url, "(?s)" + pattern, k) for k in (1, 2, 3))
    steps = F.split(path, "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.array_append(done, x))
    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    ends = F.element_at(steps, -1).isin(".", "..")
    plain = F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(site, plain, rest)).otherwise(url)


def canonical(url: Column, root: Column) -> Column:
    """The URL under the root's scheme and host; an empty path is /; query and fragment stay."""
    site = F.regexp_extract(root, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.when(url_path(url) == "", F.lit("/")).otherwise(url_path(url))
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.concat(site, path, rest)


def same_site(url: Column, root: Column) -> Column:
    host, own = F.lower(url_host(url)), F.lower(url_host(root))
    return (host == own) | (host == host_twin(own))
