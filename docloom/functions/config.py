"""Sources and settings: reading and checking the YAML file, and the boundary of a source as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = re.compile(r"^[a-z0-9][a-z0-9_-]{0,62}$")
_LIMITS = {"concurrency": (1, 16), "request_delay_ms": (0, 60_000), "request_timeout_seconds": (1, 300), "max_page_bytes": (1024, 100 * 1024 * 1024)}


class ConfigError(ValueError):
    """All that is wrong with a configuration."""


@dataclass
class Settings:
    concurrency: int = 4
    request_delay_ms: int | None = None
    request_timeout_seconds: int = 20
    max_page_bytes: int = 5 * 1024 * 1024
    respect_robots_txt: bool | None = None
    user_agent_contact: str = ""

    @property
    def delay_seconds(self) -> float:
        return (250 if self.request_delay_ms is None else self.request_delay_ms) / 1000


@dataclass
class Source:
    id: str = ""
    name: str = ""
    start_urls: list[str] = field(default_factory=list)
    allowed_prefixes: list[str] = field(default_factory=list)
    allowed_hosts: list[str] = field(default_factory=list)
    max_pages: int = 100
    max_depth: int = 0
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    keep_query_strings: bool = False
    respect_robots_txt: bool | None = None

    def allows(self, url: str) -> tuple[bool, str]:
        """Whether a URL lies within the boundary, and why not."""
        try:
            u = urlsplit(url)
            port = u.port
        except ValueError:
            return False, "not a URL"
        if u.scheme.lower() not in ("http", "https"):
            return False, "scheme"
        if "@" in u.netloc:
            return False, "credentials"
        if not u.hostname:
            return False, "host"
        host = canonical_host(u.hostname, port, u.scheme.lower())
        bare = f"{u.scheme.lower()}://{host}{u.path or '/'}"
        whole = bare + (f"?{u.query}" if u.query else "")
        if host not in self.allowed_hosts and not any(bare.startswith(p) for p in self.allowed_prefixes):
            return False, "outside"
        if self.include_patterns and not any(re.search(p, whole) for p in self.include_patterns):
            return False, "not included"
        return (False, "excluded") if any(re.search(p, whole) for p in self.exclude_patterns) else (True, "")


@dataclass
class Config:
    settings: Settings = field(default_factory=Settings)
    sources: list[Source] = field(default_factory=list)

    def source(self, id_: str) -> Source:
        for s in self.sources:
            if s.id == id_:
                return s
        raise ConfigError(f"unknown source {id_!r}")

    def respects_robots(self, s: Source) -> bool:
        return next((x for x in (s.respect_robots_txt, self.settings.respect_robots_txt) if x is not None), True)

    def request_budget(self) -> int:
        return sum(s.max_pages for s in self.sources)


def canonical_host(host: str, port: int | None, scheme: str) -> str:
    host = f"[{host.lower()}]" if ":" in host else host.lower()
    return host if port is None or port == {"http": 80, "https": 443}[scheme] else f"{host}:{port}"


def canonical_prefix(raw: str) -> str:
    """A URL with scheme and host in lower case, without default port, query and fragment; an empty path is ``/``."""
    u = absolute(raw)
    return f"{u.scheme.lower()}://{canonical_host(u.hostname, u.port, u.scheme.lower())}{u.path or '/'}"


def absolute(raw: str):  # noqa: ANN201
    """The parts of an absolute http or https URL without credentials; else a ConfigError."""
    try:
        u = urlsplit(raw.strip())
        _ = u.port
    except ValueError as e:
        raise ConfigError(f"{raw!r} is not a URL: {e}") from e
    if u.scheme.lower() not in ("http", "https"):
        raise ConfigError(f"{raw!r} must start with http:// or https://")
    if not u.hostname:
        raise ConfigError(f"{raw!r} has no host")
    if "@" in u.netloc:
        raise ConfigError(f"{raw!r} must not contain credentials")
    return u


def host_entry(raw: str) -> str:
    """An allowed host as it is compared: bare, in lower case, its port kept even where it is a scheme's default."""
    h = raw.strip().lower()
    if "*" in h:
        raise ConfigError(f"{raw!r}: wildcards are not supported")
    if not h or "/" in h or "@" in h or " " in h:
        raise ConfigError(f"{raw!r} must be a bare host name with an optional port")
    return h


def parse_config(text: str) -> Config:
    """A checked configuration; a ConfigError names everything that is wrong. Unknown keys are errors, as is an empty file."""
    import yaml

    raw = yaml.safe_load(text)
    if raw is None:
        raise ConfigError("the configuration is empty")
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    wrong = [f"unknown key {k!r}" for k in raw if k not in ("settings", "sources")]

    def build(kind, values, where):  # noqa: ANN001, ANN202
        values = values or {}
        known = kind.__dataclass_fields__
        wrong.extend(f"{where}: unknown key {k!r}" for k in values if k not in known)
        return kind(**{k: v for k, v in values.items() if k in known and v is not None})

    config = Config(build(Settings, raw.get("settings"), "settings"), [build(Source, s, f"source {n + 1}") for n, s in enumerate(raw.get("sources") or [])])
    wrong += validate(config)
    if wrong:
        raise ConfigError("; ".join(wrong))
    return config


def load_config(path: str) -> Config:
    """parse_config of a file; a missing file's error mentions a likely ``.txt`` ending."""
    import os

    if not os.path.exists(path):
        hint = f" (found {path}.txt: drop the .txt ending)" if os.path.exists(path + ".txt") else ""
        raise ConfigError(f"{path} does not exist{hint}")
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def validate(config: Config) -> list[str]:
    """Everything that is wrong; sources are brought into canonical form on the way."""
    wrong = []
    for name, (low, high) in _LIMITS.items():
        value = getattr(config.settings, name)
        if value is not None and not (isinstance(value, int) and low <= value <= high):
            wrong.append(f"{name} must be between {low} and {high}")
    if not config.sources:
        wrong.append("no sources defined")
    seen = set()
    for s in config.sources:
        at = f"source {s.id!r}: "
        if not _ID.match(s.id or ""):
            wrong.append(at + "id must be 1-63 characters of a-z, 0-9, - and _, beginning with a letter or digit")
        if s.id in seen:
            wrong.append(at + "duplicate id")
        seen.add(s.id)
        s.name = s.name or s.id
        if not (isinstance(s.max_pages, int) and 1 <= s.max_pages <= 20_000):
            wrong.append(at + "max_pages must be between 1 and 20000")
        if s.max_depth < 0:
            wrong.append(at + "max_depth must not be negative")
        if not s.allowed_prefixes and not s.allowed_hosts:
            wrong.append(at + "at least one of allowed_prefixes or allowed_hosts is needed")
        before = len(wrong)
        for name, form in (("allowed_prefixes", canonical_prefix), ("allowed_hosts", host_entry)):
            done = []
            for raw in getattr(s, name):
                try:
                    done.append(form(raw))
                except ConfigError as e:
                    wrong.append(at + str(e))
            setattr(s, name, done)
        for p in [*s.include_patterns, *s.exclude_patterns]:
            try:
                re.compile(p)
                if re.search(r"\(\?[=!<]|\\[1-9]|[*+?}]\+", p):
                    wrong.append(at + f"{p!r} is not a valid regular expression: lookaround, back references and possessive forms are not supported")
            except re.error as e:
                wrong.append(at + f"{p!r} is not a valid regular expression: {e}")
        if not s.start_urls:
            wrong.append(at + "start_urls must contain at least one URL")
        for u in s.start_urls:
            try:
                absolute(u)
            except ConfigError as e:
                wrong.append(at + str(e))
                continue
            if len(wrong) == before and not s.allows(u)[0]:
                wrong.append(at + f"{u} is outside this source's boundaries")
    return wrong


def boundary(url: Column | str, source: Source) -> Column:
    """Why a canonical URL is outside the source's boundary, or an empty text if it is inside: the rules of Source.allows."""
    u = F.col(url) if isinstance(url, str) else url
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    netloc = F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1)
    host = F.lower(netloc)
    host = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    bare = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path))
    whole = F.concat(bare, query)
    inside = host.isin(source.allowed_hosts) if source.allowed_hosts else F.lit(False)
    for p in source.allowed_prefixes:
        inside = inside | bare.startswith(p)

    def matches(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | whole.rlike(p)
        return out

    reason = F.when(~scheme.isin("http", "https"), "scheme").when(netloc.contains("@"), "credentials").when(netloc == "", "host").when(~inside, "outside")
    if source.include_patterns:
        reason = reason.when(~matches(source.include_patterns), "not included")
    return reason.when(matches(source.exclude_patterns), "excluded").otherwise("")


def plan_lines(config: Config, chosen: list[str] | None = None) -> list[str]:
    """What a run over the chosen sources (all if none) would do, a line each, and its requests; an unknown id is a ConfigError."""
    if unknown := sorted(set(chosen or ()) - {s.id for s in config.sources}):
        raise ConfigError(f"unknown source: {', '.join(unknown)}")
    own = [s for s in config.sources if not chosen or s.id in chosen]
    lines = [f"{s.id}: {len(s.start_urls)} start URLs, at most {s.max_pages} pages, robots {'on' if config.respects_robots(s) else 'off'}" for s in own]
    return [*lines, f"{sum(s.max_pages for s in own)} requests at most"]


def user_agent(version: str, contact: str = "", name: str = "docloom") -> str:
    """The User-Agent of a fetcher."""
    return f"{name}/{version}" + (f" (+{contact})" if contact else "")
