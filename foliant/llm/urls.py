"""URL filter: a trie over reversed host labels and path segments, sent to every task, longest match first.

Rules are few and their number is checked before they are sent (`MAX_RULES`); pages are never shuffled.
A rule covers its host and all subdomains where the url's path starts with the rule's path. Of the rules that fit, the
longest wins, host and path taken together; of equally long ones the one with the longer host, and a block entry over an
allow entry for the same host and path.

Defined cases: a null url, or one without `://`, has an empty host and path and fits only a rule with an empty host;
urls of any length are judged whole; repeated pages give repeated rows; an empty table gives an empty one; columns other
than the id and the url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is sent to each task is at most so many entries with so many characters in all.
MAX_RULES, MAX_CHARACTERS = 1_000_000, 50_000_000

HOST = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = ""


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    found = F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


class HostPathTrie:
    """Edges are host labels from the right, then whole path segments; the last, open segment of a rule is a prefix."""

    def __init__(self, rules: Sequence[UrlRule]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to the tasks")
        if (characters := sum(len(r.host) + len(r.path) for r in rules)) > MAX_CHARACTERS:
            raise ValueError(f"rules of {characters} characters; at most {MAX_CHARACTERS} are sent to the tasks")
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            *segments, last = rule.path.split("/")
            node = node.setdefault("paths", {})
            for segment in segments:
                node = node.setdefault("next", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(last, ("", "allow"))[1] != "block":
                ends[last] = (rule.host + rule.path, rule.verdict)
                node.setdefault("lengths", set()).add(len(last))
        stack = [self.root]
        while stack:  # lengths once, the longest first
            node = stack.pop()
            if "lengths" in node:
                node["lengths"] = sorted(node["lengths"], reverse=True)
            stack += [*node.get("labels", {}).values(), *node.get("next", {}).values(), *([node["paths"]] if "paths" in node else [])]

    @staticmethod
    def _by_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for depth in range(len(segments)):
            for length in node.get("lengths", ()):  # of the ends at this node, at most as many as a segment has characters
                if (end := node["ends"].get(segments[depth][:length])) and length <= len(segments[depth]):
                    best = end
                    break
            if (node := node.get("next", {}).get(segments[depth])) is None or depth + 1 == len(segments):
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule as host and path, its verdict) of the longest match, or None."""
        node, segments = self.root, path.split("/")
        best = self._by_path(node["paths"], segments) if "paths" in node else None
        for label in reversed(host.split(".")):
            if (node := node.get("labels", {}).get(label)) is None:
                break
            found = self._by_path(node["paths"], segments) if "paths" in node else None
            if found and (best is None or len(found[0]) >= len(best[0])):  # at a deeper node, so with a longer host
                best = found
        return best


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null where none fits), verdict."""
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast(HostPathTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = sent.value
        for hosts, paths in parts:
            found = [trie.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [x and x[0] for x in found], "verdict": [x[1] if x else default for x in found]}, dtype=object)

    url = F.col(url_col).cast("string")
    split = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    return split.withColumn("_j", judged("host", "path")).select(id_col, "host", "path", F.col("_j.rule").alias("rule"), F.col("_j.verdict").alias("verdict"))
