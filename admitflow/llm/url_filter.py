"""URL filter: a broadcast trie over reversed host labels and path segments, longest match wins.

Rules are (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with
the rule's path. Of the fitting rules, that with the longest host wins, then the longest path; of an
allow and a block entry with the same host and path, the block wins. A url that no rule fits gets the
default verdict. A null url, or one without "://", has an empty host and path and fits no rule.
Empty tables give empty results; input columns are kept apart from the added ones by `select`.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.plans.shared import free_name

#: Rules up to this number are broadcast as a trie (well under 100 MB); more are joined by host.
MAX_TRIE_RULES = 200_000

#: The registered query's rules: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first "://" up to / ? # or the end, A-Z lower-cased; path from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


class RuleTrie:
    """Nodes are dicts: host labels from the last one back, then under "/" the path segments.

    A node's "=" holds the entries that end there: (rest of the rule's path after its last full
    segment, rule, verdict), longest rest first. An entry fits if the url's next segment starts with the rest.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        best: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            host = host.translate(str.maketrans(_UPPER, _LOWER))
            if verdict not in ("allow", "block") or (path and not path.startswith("/")):
                raise ValueError(f"not a rule: {(verdict, host, path)}")
            best[host, path] = "block" if "block" in (verdict, best.get((host, path))) else verdict
        for (host, path), verdict in best.items():
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *full, rest = path.split("/") if path else [None]
            for segment in full:  # the first is what stands before the leading slash: ""
                node = node.setdefault(("path", segment), {})
            node.setdefault("=", []).append((rest or "", host + path, verdict))
            node["="].sort(key=lambda e: (-len(e[0]), e))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest fitting rule, or (None, None)."""
        nodes, node = [], self.root
        for label in reversed(host.split(".")):
            if (node := node.get(("host", label))) is None:
                break
            nodes.append(node)
        segments = path.split("/") if path else []
        for node in reversed(nodes):
            walk, found = node, None
            for depth in range(len(segments) + 1):
                ahead = segments[depth] if depth < len(segments) else ""
                found = next((e for e in walk.get("=", ()) if ahead.startswith(e[0])), found)
                if depth == len(segments) or (walk := walk.get(("path", segments[depth]))) is None or depth + 1 == len(segments):
                    break
            if found:
                return found[1], found[2]
        return None, None


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, url: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """pages' columns without any named host, path, rule or verdict, then those four."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(f"`{url}`"))
    split = pages.select(*keep, host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        if rules.limit(max_trie_rules + 1).count() > max_trie_rules:
            return _by_join(split, rules, default)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    rules = list(rules)
    if len(rules) > max_trie_rules:
        return _by_join(split, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([trie.value.match(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    found = free_name("_found", split.columns)
    return _shown(split.withColumn(found, judge("host", "path")), split.columns, found, default)


def _shown(judged: DataFrame, columns: list[str], found: str, default: str) -> DataFrame:
    return judged.select(*[f"`{c}`" for c in columns], F.col(f"{found}.rule").alias("rule"), F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict"))


def _by_join(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same result for rule tables too large to broadcast: host suffixes meet rules in a shuffled join."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("_host"), F.col("path").alias("_path"), "verdict")
    rules = rules.groupBy("_host", "_path").agg(F.min_by("verdict", F.col("verdict") != "block").alias("_verdict"))
    urls, found = split.select("host", "path").distinct(), free_name("_best", split.columns)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = urls.select("host", "path", F.explode(suffixes).alias("_host")).join(rules, "_host").filter(F.startswith("path", "_path"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict")), F.struct(F.length("_host"), F.length("_path"))).alias(found))
    return _shown(split.join(best, ["host", "path"], "left"), split.columns, found, default)
