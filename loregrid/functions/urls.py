"""Hosts, domains and canonical URLs."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track visits.
TRACKING = ("fbclid", "gclid")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def in_domain(h: Column, domain: str) -> Column:
    """The host is the domain or lies below it."""
    return (h == domain) | h.endswith("." + domain)


def parents(h: Column) -> Column:
    """The host and its parents of two labels at least; an IP address or a single label is alone."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    up = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    return F.when((n < 2) | h.rlike(r"^[0-9.]+$"), F.array(h)).otherwise(up)


def title(url: Column) -> Column:
    """The host and the path without a slash at the end."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(host(url), path)


def domain_list(domains: list[str]) -> list[str]:
    """Folded, without ``*.`` and outer dots, each once."""
    clean = [d.strip().lower().removeprefix("*.").strip(".") for d in domains]
    return list(dict.fromkeys(d for d in clean if d))


def allowed(url: Column, allow: list[str], deny: list[str]) -> Column:
    """An http(s) URL without user information whose host no denied domain covers and an allowed one does, if any is named."""
    h = F.regexp_replace(host(url), r"\.$", "")
    some = lambda ds: F.exists(F.array(*map(F.lit, domain_list(ds))), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d))) if domain_list(ds) else F.lit(False)
    fine = url.rlike(r"^(?i:https?)://[^/?#@]+(?:[/?#]|$)") & (h != "")
    return F.coalesce(fine & ~some(deny) & (some(allow) if domain_list(allow) else F.lit(True)), F.lit(False))


def canonical(url: str | None, web_only: bool = False) -> str:
    """Lower-case scheme and host, no fragment, user information, default port or tracking parameter, sorted query; empty if it is no URL."""
    try:
        parts = urlsplit((url or "").strip())
        port = parts.port
    except ValueError:
        return ""
    scheme = parts.scheme.lower()
    if not scheme or (web_only and (scheme not in ("http", "https") or not parts.hostname)):
        return ""
    name = parts.hostname or ""
    name = f"[{name}]" if ":" in name else name
    if port is not None and (scheme, port) not in (("http", 80), ("https", 443)):
        name += f":{port}"
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING]
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(kept, key=lambda kv: kv[0]))
    path = parts.path or ("/" if scheme in ("http", "https") else "")
    middle = f"//{name}" if parts.netloc or url.strip()[len(scheme) + 1 :].startswith("//") else ""
    return f"{scheme}:{middle}{path}" + (f"?{query}" if query else "")


@F.pandas_udf(StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    return urls.map(canonical)
