"""Robots rules. Parsing is a Python function for one file a host; matching is a join and one aggregation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Group(NamedTuple):
    agents: tuple[str, ...]
    allow: tuple[str, ...]
    disallow: tuple[str, ...]
    delay: float | None


def parse(content: str | None) -> list[Group]:
    """Groups in file order. Agent lines in a row share a group, until it has a rule; an empty Disallow says nothing; the
    last delay counts."""
    groups: list[dict] = []
    for line in (content or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not groups or groups[-1]["ruled"]:
                groups.append({"agents": [], "allow": [], "disallow": [], "delay": None, "ruled": False})
            groups[-1]["agents"].append(value.lower())
        elif groups and name in ("allow", "disallow", "crawl-delay"):
            group = groups[-1]
            group["ruled"] = True
            if name == "crawl-delay":
                number = re.match(r"\d+(\.\d+)?", value)
                group["delay"] = float(number[0]) if number else group["delay"]
            elif value:
                group[name].append(value)
    return [Group(tuple(g["agents"]), tuple(g["allow"]), tuple(g["disallow"]), g["delay"]) for g in groups]


def select(groups: list[Group], agent: str) -> Group | None:
    """The first group one of whose agents, other than *, is part of our agent's name; else that of *."""
    own = next((g for g in groups if any(a not in ("*", "") and a in agent.lower() for a in g.agents)), None)
    return own or next((g for g in groups if "*" in g.agents), None)


def delay_ms(group: Group | None) -> int | None:
    return None if group is None or group.delay is None else round(group.delay * 1000)


def pattern_regex(pattern: Column) -> Column:
    quoted = F.regexp_replace(pattern, r"([\\.^|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")))


def allowed(urls: DataFrame, rules: DataFrame, *, key: str = "host", path: str = "path") -> DataFrame:
    """urls with allowed: of the rules (host, kind allow or disallow, pattern) that match the path, the longest decides,
    disallow at equal length; without any, the path is allowed. The query plays no part. Rules of a host are few."""
    own = rules.select(F.col(key).alias("_host"), "kind", "pattern", pattern_regex(F.col("pattern")).alias("_regex"))
    row = urls.withColumn("_row", F.monotonically_increasing_id())
    met = row.join(own, (F.col(key) == F.col("_host")), "left").withColumn("_met", F.coalesce(F.expr(f"`{path}` RLIKE _regex"), F.lit(False)))
    last = F.max(F.when(F.col("_met"), F.struct(F.length("pattern").alias("n"), (F.col("kind") == "disallow").alias("no"))))
    return met.groupBy("_row", *urls.columns).agg(last.alias("_last")).select(*urls.columns, F.coalesce(~F.col("_last.no"), F.lit(True)).alias("allowed"))


def rules(files: DataFrame, agent: str) -> DataFrame:
    """files (host, body) to the rules of the group that applies to the agent: host, kind (allow, disallow or, without a
    pattern, delay), pattern, delay_ms. A host without a file, or without a group, has no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for host, body in zip(frame["host"], frame["body"], strict=True):
                group = select(parse(body), agent)
                if group:
                    rows += [(host, kind, p, None) for kind in ("allow", "disallow") for p in getattr(group, kind)]
                    if delay_ms(group) is not None:
                        rows.append((host, "delay", None, delay_ms(group)))
            yield pd.DataFrame(rows, columns=["host", "kind", "pattern", "delay_ms"]).astype({"delay_ms": "Int64"})

    return files.where("body is not null").select("host", "body").mapInPandas(run, "host string, kind string, pattern string, delay_ms long")
