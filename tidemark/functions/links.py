"""Canonical links: repositories to their root, papers to their abstract, other pages without tracking parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track; owners that are not repositories.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid"]
NOT_OWNERS = ["settings", "marketplace", "sponsors"]

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _plain(x: Column) -> Column:
    """A part of a query decoded; as it stands, but for +, where its percent signs are malformed."""
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _pair(part: Column) -> Column:
    """Key and value; a key alone has the empty value."""
    key = F.split_part(part, F.lit("="), F.lit(1))
    return F.struct(_plain(key).alias("k"), _plain(F.substr(part, F.length(key) + 2)).alias("v"))


def _quoted(x: Column) -> Column:
    """Encoded for a query: letters, digits and _.-~ stand, a space becomes +."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_link(url: Column) -> Column:
    raw = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(raw, _URL, i)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), F.substring(part(4), 2, 1 << 30)
    bare = F.regexp_replace(host, ":.*$", "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    owner, repo = F.lower(F.try_element_at(segments, F.lit(1))), F.lower(F.try_element_at(segments, F.lit(2)))
    github = (bare == "github.com") | (bare.endswith(".github.com") & (bare != "gist.github.com"))
    gitlab = bare.isin("gitlab.com", "www.gitlab.com")
    two = F.size(segments) >= 2
    paper = F.regexp_extract(path, r"(?i)^/(?:abs/([^?#]+?)|pdf/([^?#]+?)(?:\.pdf)?)/?$", 1)
    pdf = F.regexp_extract(path, r"(?i)^/pdf/([^?#]+?)(?:\.pdf)?/?$", 1)
    number = F.regexp_replace(F.trim(F.when(paper != "", paper).otherwise(pdf), F.lit("/")), r"v\d+$", "")
    trimmed = F.when(path == "", "/").when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/+$", "")).otherwise(path)
    trimmed = F.regexp_replace(trimmed, r";[^/]*$", "")
    kept = F.array_join(F.transform(F.filter(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), _pair), lambda p: ~F.lower(p["k"]).isin(TRACKING)), lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    plain = F.concat(scheme, F.lit("://"), host, trimmed, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return (
        F.when(host == "", raw)
        .when(github & two & ~owner.isin(NOT_OWNERS), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), F.regexp_replace(repo, r"\.git$", "")))
        .when(gitlab & two, F.concat(F.lit("https://gitlab.com/"), owner, F.lit("/"), repo))
        .when(host.contains("arxiv.org") & (number != ""), F.concat(F.lit("https://arxiv.org/abs/"), number))
        .when(~scheme.isin("http", "https"), raw)
        .otherwise(plain)
    )


def kind_of_link(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("arxiv.org"), "paper").when(low.contains("github.com") | low.contains("gitlab.com"), "repo").otherwise("news")
