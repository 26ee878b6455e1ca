"""URL canonicalization: the full rules in Python for Arrow UDFs, and Column expressions for the common subset."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, and endings of files that hold no page.
TRACKING = ("fbclid", "gclid", "ref_src")
NON_HTML = frozenset(
    """.7z .apk .avi .bin .bmp .bz2 .css .csv .deb .dmg .doc .docx .eot .epub .exe .gif .gz .ico .iso .jar .jpeg .jpg .js .json .map .mjs .mov .mp3 .mp4 .msi
    .ogg .otf .pdf .png .ppt .pptx .rar .rpm .rss .svg .tar .tgz .ttf .txt .wasm .wav .webm .webp .woff .woff2 .xls .xlsx .xml .xz .zip .atom .whl .egg .py
    .ipynb""".split()
)
_PORTS = {"http": "80", "https": "443"}
_SAFE = "!$&'()*+,;=:@-._~"


def clean_path(path: str) -> str:
    """``.``, ``..`` and doubled slashes removed; an empty path is ``/``; a slash at the end stays."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    clean = "/" + "/".join(out)
    return clean + "/" if clean != "/" and path.endswith("/") else clean


def clean_query(query: str) -> str:
    """Query without tracking keys, sorted by key (values of a key keep their order); a query that can't be read is dropped."""
    if re.search(r"%(?![0-9A-Fa-f]{2})|;", query):
        return ""
    pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING)]
    return "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(pairs, key=lambda p: p[0]))


def normalize(raw: str | None, keep_query: bool = False) -> str | None:
    """The canonical form of an absolute http or https URL; None for anything else.

    Scheme and host in lower case, default port, fragment, credentials-free, one final dot of the host dropped, path
    cleaned and percent-encoded canonically unless it holds an encoded slash, query dropped unless kept.
    """
    if raw is None:
        return None
    try:
        u = urlsplit(raw.strip())
        port, host = u.port, u.hostname
    except ValueError:
        return None
    scheme = u.scheme.lower()
    if scheme not in _PORTS or not host or "@" in u.netloc or not raw.strip()[len(scheme) :].startswith("://"):
        return None
    host = host.lower()
    host = host[:-1] if host.endswith(".") else host
    if not host:
        return None
    host = f"[{host}]" if ":" in host else host
    if port is not None and str(port) != _PORTS[scheme]:
        host += f":{port}"
    path = clean_path(u.path) if re.search("%2f", u.path, re.IGNORECASE) else quote(clean_path(unquote(u.path)), safe="/" + _SAFE)
    query = clean_query(u.query) if keep_query else ""
    return f"{scheme}://{host}{path}" + (f"?{query}" if query else "")


def resolve(base: str | None, href: str | None, keep_query: bool = False) -> str | None:
    """The canonical URL of a link on a page; None for empty links, fragments and other schemes."""
    if base is None or href is None or not href.strip() or href.strip().startswith("#"):
        return None
    try:
        return normalize(urljoin(base, href.strip()), keep_query)
    except ValueError:
        return None


def span_href(base: str, href: str | None) -> str:
    """The canonical URL of a link in a text, its fragment kept; an empty text for what isn't http."""
    if not href or not href.strip():
        return ""
    whole = urljoin(base, href.strip())
    bare, _, fragment = whole.partition("#")
    url = normalize(bare, keep_query=True)
    return "" if url is None else url + (f"#{fragment}" if fragment else "")


def likely_non_html(url: str) -> bool:
    """Whether the last part of a URL's path ends like a file that is no page."""
    path = urlsplit(url).path
    dot = path.rfind(".")
    return dot > path.rfind("/") and path[dot:].lower() in NON_HTML


def origin(url: str) -> str:
    """Scheme and host of a URL."""
    u = urlsplit(url)
    return f"{u.scheme}://{u.netloc}"


def normalize_col(url: Column | str, keep_query: bool = False) -> Column:
    """normalize as an Arrow UDF: the rules for escapes and IPv6 can't be said in expressions."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda u: normalize(u, keep_query), na_action="ignore")

    return run(url)


def resolve_col(base: Column | str, href: Column | str, keep_query: bool = False) -> Column:
    """resolve as an Arrow UDF."""

    @F.pandas_udf("string")
    def run(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([resolve(x, y, keep_query) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(b, h)], dtype=object)

    return run(base, href)


def simple_normalize(url: Column | str) -> Column:
    """The canonical form by expressions, for URLs without escapes, IPv6 hosts and ``..``: inside generated code."""
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    host = F.regexp_replace(host, r"\.(?=$|:)", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"/(?:\.?/)+", "/")
    path = F.when(path == "", "/").otherwise(path)
    good = scheme.isin("http", "https") & (host != "") & ~host.contains("@")
    return F.when(good, F.concat(scheme, F.lit("://"), host, path))


def simple_clean_query(url: Column | str) -> Column:
    """The query of a URL without tracking keys, its parameters in order; an empty text where nothing is left."""
    q = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    key = lambda p: F.lower(F.split(p, "=")[0])
    kept = F.filter(F.split(q, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    return F.array_join(F.array_sort(kept), "&")


def non_html_col(url: Column | str) -> Column:
    """likely_non_html as an expression."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*sorted(NON_HTML))


def origin_col(url: Column | str) -> Column:
    """Scheme and host of a URL, as an expression."""
    return F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)
