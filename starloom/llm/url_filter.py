"""URL filter: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

# Rules travel to every task, so their number is bounded.
MOST_RULES = 1_000_000

_PATHS, _END = 0, 1
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


class Rule(NamedTuple):
    """``verdict`` for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the right, then path segments."""
    root: dict = {}
    for n, rule in enumerate(rules):
        if n >= MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules; filter against a table of rules by a join instead")
        if not (rule.path.startswith("/") and rule.path.endswith("/")):
            raise ValueError(f"the path of a rule starts and ends with a slash: {rule}")
        node = root
        for label in reversed(rule.host.translate(_UPPER).split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATHS, {})
        for segment in rule.path.split("/")[1:-1]:
            node = node.setdefault(segment, {})
        end = (rule.verdict, f"{rule.host.translate(_UPPER)}{rule.path}")
        if node.setdefault(_END, end) != end:
            raise ValueError(f"allowed and blocked at once: {end[1]}")
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path; both empty without ``://``."""
    found = _PARTS.search(url) if url else None
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Verdict and rule of the deepest host that fits, and there of the deepest path."""
    best = None
    segments = path.split("/")[1:-1] if path.startswith("/") else None
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        paths = node.get(_PATHS)
        if paths is None or segments is None:
            continue
        found = paths.get(_END)
        for segment in segments:
            paths = paths.get(segment)
            if paths is None:
                break
            found = paths.get(_END, found)
        best = found or best
    return best


def filter_urls(pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each page.

    The rule with more host labels wins, then the one with more path segments.
    A url that no rule fits, and one that is null, empty or without ``://``,
    gets the default verdict and a null rule. Repeated rows are each judged.
    Columns of the pages named like an added one are replaced.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in added]
    schema = pages.select(*kept).schema
    for name in added:
        schema = schema.add(name, "string")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [split_url(u) for u in frame[url]]
            found = [longest_match(trie.value, *part) for part in parts]
            yield frame.assign(
                host=[p[0] for p in parts],
                path=[p[1] for p in parts],
                rule=[f[1] if f else None for f in found],
                verdict=[f[0] if f else default for f in found],
            )

    return pages.select(*kept).mapInPandas(judge, schema)
