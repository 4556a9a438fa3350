"""URLs: validity, normal form, joining, keys and provider addresses.

The forms for ASCII URLs are expressions; exact_normal() and exact_join() follow the standards to the end, in Arrow batches."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode import rules
from pagelode.functions.shipping import ship_package
from pagelode.functions.text import let

_ORIGIN = r"^(?i)(https?)://([^/?#\s]+)"
#: URLs that are in normal form already, but for their length.
_NORMAL = r"^https?://[a-z0-9._-]+/.*\z"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(u: Column) -> Column:
    """Host and port in lower case: the key of everything kept by site."""
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def origin(u: Column) -> Column:
    return F.concat(scheme(u), F.lit("://"), netloc(u))


def normal(u: Column) -> Column:
    """Normal form of an http or https URL of ASCII text, null for any other: lower-case scheme and host, no default port, a path."""
    return let(u, lambda x: F.when(x.rlike(_NORMAL) & (F.length(x) <= 2083), x).otherwise(_normal(x)))


def _normal(u: Column) -> Column:
    host = F.regexp_replace(netloc(u), F.when(scheme(u) == "https", r":443$").otherwise(r":80$"), "")
    rest = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    good = u.rlike(_ORIGIN) & (F.length(u) <= 2083)
    return F.when(good, F.concat(scheme(u), F.lit("://"), host, rest))


def join(base: Column, ref: Column) -> Column:
    """A reference against a base URL; what has a scheme stays. Dot segments aren't folded here."""
    return let(ref, lambda r: _joined(base, r))


def _joined(base: Column, ref: Column) -> Column:
    folder = F.concat(origin(base), F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), r"[^/]*$", ""))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin(base), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), ref))
        .otherwise(F.concat(folder, ref))
    )


def _exact_normal(u: str | None) -> str | None:
    try:
        parts = urlsplit((u or "").strip())
        host, port = parts.hostname, parts.port
        if parts.scheme.lower() not in ("http", "https") or not host or len(u) > 2083:
            return None
        host = host if host.isascii() else host.encode("idna").decode()
        host = f"[{host}]" if ":" in host else host
        if port and port != {"http": 80, "https": 443}[parts.scheme.lower()]:
            host += f":{port}"
        folded: list[str] = []
        pieces = parts.path.split("/")[1:]
        for k, piece in enumerate(pieces):
            if piece in (".", ".."):
                folded[-1:] = [] if piece == ".." else folded[-1:]
                if k == len(pieces) - 1:
                    folded.append("")
            else:
                folded.append(piece)
        keep = "!#$%&'()*+,/:;=?@[]~-._"
        out = f"{parts.scheme.lower()}://{host}/" + quote("/".join(folded), keep)
        out += f"?{quote(parts.query, keep)}" if parts.query else ""
        return out + (f"#{quote(parts.fragment, keep)}" if parts.fragment else "")
    except (ValueError, UnicodeError):
        return None


def _mapped(f: Callable, *columns: Column) -> Column:
    """A Python function of strings over Arrow batches."""
    ship_package()

    def one(a: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in a], dtype=object)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(one if len(columns) == 1 else two, "string")(*columns)


def exact_normal(u: Column) -> Column:
    """Normal form by the whole standard: names in other scripts, dot segments, percent encoding."""
    return _mapped(_exact_normal, u)


def exact_join(base: Column, ref: Column) -> Column:
    """A reference against a base URL by the whole standard."""
    return _mapped(lambda a, b: None if a is None or b is None else urljoin(a, b), base, ref)


def _blocked(u: str | None) -> str | None:
    try:
        parts = urlsplit(u or "")
        host = parts.hostname
    except ValueError:
        return "invalid url"
    if parts.scheme.lower() not in ("http", "https"):
        return "scheme"
    if not host:
        return "no host"
    if host == "localhost" or host.endswith(".localhost"):
        return "localhost"
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return None
    return "private address" if ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast else None


def blocked_reason(u: Column) -> Column:
    """Why a URL must not be fetched (scheme, host or literal private address), or null."""
    return _mapped(_blocked, u)


def board(u: Column) -> Column:
    """The first segment of the path, else the first label of the host."""
    segment = F.regexp_extract(path_of(u), r"^/*([^/]+)", 1)
    return F.when(segment != "", segment).otherwise(F.regexp_extract(netloc(u), r"^([^.]*)", 1))


def api_url(u: Column, provider: Column) -> Column:
    """The listing API of a page whose provider has a template."""
    out = F.lit(None).cast("string")
    for name, _, template in rules.URL_RULES:
        if template:
            out = F.when(provider == name, F.replace(F.lit(template), F.lit("{board}"), board(u))).otherwise(out)
    return out


def provider_api(u: Column, provider: Column) -> Column:
    """The address that a provider's reader asks for."""
    slug = F.regexp_extract(netloc(u), r"^([^.]*)", 1)
    host = F.concat(F.lit("https://"), netloc(u))
    more = F.when(u.contains("?"), "&").otherwise("?")
    return (
        F.when(provider.isin("greenhouse", "lever", "smartrecruiters"), api_url(u, provider))
        .when(provider == "teamtailor", F.when(netloc(u).contains(rules.TEAMTAILOR_HOST), u).otherwise(F.concat(F.lit(rules.TEAMTAILOR_API), slug)))
        .when(provider == "recruitee", F.when(path_of(u).contains(rules.RECRUITEE_PATH), u).otherwise(F.concat(host, F.lit(rules.RECRUITEE_PATH))))
        .when(provider == "pinpoint", F.when(u.endswith(".json") | path_of(u).contains(rules.PINPOINT_PATH), u).otherwise(F.concat(host, F.lit(rules.PINPOINT_PATH))))
        .when(provider == "breezy", F.when(path_of(u).endswith(rules.BREEZY_PATH), u).otherwise(F.concat(host, F.lit(rules.BREEZY_PATH))))
        .when(provider == "phenom", F.lit(rules.PHENOM_API))
        .when(
            provider == "sap_successfactors",
            F.when(path_of(u).contains(rules.ODATA_PATH), F.when(u.contains(rules.ODATA_FORMAT), u).otherwise(F.concat(u, more, F.lit(rules.ODATA_FORMAT)))).otherwise(
                F.concat(origin(u), F.lit(f"{rules.ODATA_PATH}?{rules.ODATA_FORMAT}"))
            ),
        )
    )


def sap_sitemap(u: Column) -> Column:
    return F.concat(origin(u), F.lit(rules.SITEMAP_PATHS[2]))


def robots_url(u: Column) -> Column:
    return F.concat(origin(u), F.lit(rules.ROBOTS_PATH))


def ashby_slug(u: Column, html: Column) -> Column:
    """The organisation's name from the page (its JSON first, then its links), else from the URL: its path's first part but for `api`, else its host's first label."""
    in_json = F.nullif(F.regexp_extract(html, rules.ASHBY_SLUG_JSON, 1), F.lit(""))
    in_links = F.get(F.filter(F.regexp_extract_all(html, F.lit(rules.ASHBY_SLUG_URL), F.lit(1)), lambda s: ~s.isin("api", "job-board")), F.lit(0))
    segment = F.regexp_extract(path_of(u), r"^/*([^/]+)", 1)
    return F.coalesce(in_json, in_links, F.when(~segment.isin("", "api"), segment), F.regexp_extract(netloc(u), r"^([^.]*)", 1))


def ashby_payload(slug: Column, question: str) -> Column:
    """The body of a board's GraphQL request: the question that the caller gives, and the board's name as its variable."""
    return F.to_json(F.struct(F.lit(question).alias("query"), F.struct(slug.alias("organizationHostedJobsPageName")).alias("variables")))


def url_score(u: Column) -> Column:
    """How likely a URL is a careers page: the highest score of its matches, 0 without any."""
    return F.greatest(F.lit(0.0), *(F.when(u.rlike(p), s).otherwise(0.0) for s, p in rules.URL_SCORES))
