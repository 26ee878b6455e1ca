"""robots.txt: rules of a token, as rows, and the decision on paths by a join and an aggregation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a robots.txt that are read, and the longest delay that is honoured, in seconds.
LIMIT, MOST_DELAY = 512 * 1024, 30.0


@dataclass
class Rules:
    """Rules that hold for a token: (allow, pattern) in order, a delay in seconds, or a ban of everything."""

    rules: list[tuple[bool, str]] = field(default_factory=list)
    crawl_delay: float = 0.0
    disallow_all: bool = False

    def allowed(self, path: str) -> bool:
        """The longest pattern that matches decides, Allow before Disallow; robots.txt itself is always allowed."""
        if path == "/robots.txt":
            return True
        if self.disallow_all:
            return False
        hits = [(len(p.encode()), a) for a, p in self.rules if re.match(pattern_regex(p), path, re.DOTALL)]
        return max(hits)[1] if hits else True


def pattern_regex(pattern: str) -> str:
    """A pattern with ``*`` and a final ``$`` as a regular expression anchored at the start."""
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*"))
    return "^" + body + ("$" if end else "")


_RECORD = re.compile(r"\s*([^:#]*?)\s*:\s*([^#]*?)\s*(?:#.*)?")


def parse(text: str | None, token: str) -> Rules:
    """The rules of the group for ``token``: the longest agent name contained in it, else the first ``*`` group.

    The text is read as records (name, value); runs of user-agent records and what follows each are its groups. Groups of
    the same agent aren't merged, the first one holds; lines that are no records end nothing; an empty value says nothing.
    """
    lines = (text or "").encode()[:LIMIT].decode(errors="replace").splitlines()
    records = [(m[1].lower(), m[2]) for m in map(_RECORD.fullmatch, lines) if m]
    runs = [(named, list(run)) for named, run in groupby(records, lambda r: r[0] == "user-agent")]
    following = [body for _, body in runs[1:]] + [[]]
    groups = [([v.lower() for _, v in run], body) for (named, run), body in zip(runs, following) if named]

    def fit(group: tuple[list[str], list]) -> int:
        """Length of the longest name that the token has, 0 for a group of all agents, -1 for one of others."""
        return max([len(a) for a in group[0] if a not in ("", "*") and a in token.lower()], default=0 if "*" in group[0] else -1)

    chosen = max(groups, key=fit, default=([], []))
    if fit(chosen) < 0:
        return Rules()
    delays = [float(v) for name, v in chosen[1] if name == "crawl-delay" and _NUMBER.fullmatch(v)]
    return Rules([(name == "allow", v) for name, v in chosen[1] if name in ("allow", "disallow") and v], delays[-1] if delays else 0.0)


_NUMBER = re.compile(r"\d+(?:\.\d*)?|\.\d+")


def for_response(status: int | None, body: str | None, token: str) -> Rules:
    """Rules of a fetched robots.txt: parsed if found, none for 3xx and 4xx, everything banned for errors."""
    if status is not None and 200 <= status < 300:
        return parse(body, token)
    return Rules() if status is not None and 300 <= status < 500 else Rules(disallow_all=True)


def rule_rows(responses: DataFrame, token: str) -> DataFrame:
    """(origin, allow, pattern, length, regex, crawl_delay, disallow_all): a row for each rule; an origin without rules has one row with null pattern."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for origin, status, body in zip(pdf["origin"], pdf["status"], pdf["body"]):
                r = for_response(None if pd.isna(status) else int(status), body if isinstance(body, str) else None, token)
                rows = r.rules or [(None, None)]
                out += [(origin, a, p, len(p.encode()) if p else None, pattern_regex(p) if p else None, min(r.crawl_delay, MOST_DELAY), r.disallow_all) for a, p in rows]
            yield pd.DataFrame(out, columns=["origin", "allow", "pattern", "length", "regex", "crawl_delay", "disallow_all"])

    return responses.select("origin", "status", "body").mapInPandas(run, "origin string, allow boolean, pattern string, length int, regex string, crawl_delay double, disallow_all boolean")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled: dict[str, re.Pattern] = {}
    for rb in batches:
        out = []
        for path, rules, ban in zip(*(rb.column(c).to_pylist() for c in ("_path", "_rules", "_ban"))):
            best = None
            for r in () if ban or path is None else rules or ():
                if r["regex"] not in compiled:
                    compiled[r["regex"]] = re.compile(r["regex"], re.DOTALL)
                if (best is None or (r["length"], r["allow"]) > best) and compiled[r["regex"]].match(path):
                    best = r["length"], r["allow"]
            out.append(path == "/robots.txt" or not ban and (best is None or best[1]))
        keep = [c for c in rb.schema.names if c not in ("_path", "_rules", "_ban")]
        yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(out, pa.bool_())], [*keep, "allowed"])


def decide(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with ``allowed``: by origin, the longest matching pattern, Allow before Disallow; unknown origins allow all.

    An origin's rules are one array: a robots.txt of LIMIT bytes bounds it. Each pattern is compiled once in a task.
    """
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    path = F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path)
    known = rules.groupBy("origin").agg(F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("length", "allow", "regex"))).alias("_rules"), F.max("disallow_all").alias("_ban"))
    joined = urls.withColumn("_path", path).withColumn("_origin", F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)))
    joined = joined.join(known.withColumnRenamed("origin", "_origin"), "_origin", "left").drop("_origin").withColumn("_ban", F.coalesce("_ban", F.lit(False)))
    schema = T.StructType([*urls.schema.fields, T.StructField("allowed", T.BooleanType())])
    return joined.select(*urls.columns, "_path", "_rules", "_ban").mapInArrow(_judge, schema)
