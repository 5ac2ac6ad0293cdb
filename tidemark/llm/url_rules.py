"""URL allow and block rules in a trie over reversed host labels and path segments.

A rule names a host (it fits that host and every subdomain) and the start of a path. The trie descends the host from its
last label, then the path by whole segments; the last segment of a rule is a prefix, kept at the node before it. The
longest fitting rule decides, counted in characters of host and path; of two equally long ones, blocking wins.

The compiled trie is broadcast only up to ``TRIE_BYTES`` of rules; a longer list is judged in parts of that size, each
adding its best match to a page, and the longest of them decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

TRIE_BYTES = 32 << 20
DEFAULT = "allow"
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = {c: c + 32 for c in range(65, 91)}

Rule = tuple[str, str, str]  # verdict, host, path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0] if url[host.end() : host.end() + 1] == "/" else ""


def compile_trie(rules: Sequence[Rule]) -> dict:
    """Nested maps: ``("h", label)`` and ``("p", segment)`` lead on, ``"tails"`` lists (prefix, verdict, name)."""
    root: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or path and not path.startswith("/"):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
        node = root
        for label in reversed(host.translate(_LOWER).split(".")) if host else ():
            node = node.setdefault(("h", label), {})
        *whole, tail = path.split("/") if path else [None]
        for segment in whole:
            node = node.setdefault(("p", segment), {})
        node.setdefault("tails", []).append((tail, verdict, f"{host.translate(_LOWER)}{path}"))
    return root


def longest(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """``(rule, verdict)`` of the longest fitting rule."""
    best = None
    segments = path.split("/") if path else []

    def look(node: dict) -> None:
        nonlocal best
        for depth, segment in enumerate([None, *segments]):
            if depth:
                for tail, verdict, name in node.get("tails", ()):
                    if tail is not None and segment.startswith(tail):
                        best = _better(best, name, verdict)
                node = node.get(("p", segment))
                if node is None:
                    return
            else:
                for tail, verdict, name in node.get("tails", ()):
                    if tail is None:
                        best = _better(best, name, verdict)

    look(trie)
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(("h", label))
        if node is None:
            break
        look(node)
    return best


def _better(best: tuple[str, str] | None, name: str, verdict: str) -> tuple[str, str]:
    if best is None or (len(name), verdict == "block") > (len(best[0]), best[1] == "block"):
        return name, verdict
    return best


def _parts(rules: Sequence[Rule], most: int) -> Iterator[list[Rule]]:
    part, size = [], 0
    for rule in rules:
        part.append(rule)
        size += sum(map(len, rule)) + 64
        if size > most:
            yield part
            part, size = [], 0
    yield part


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = DEFAULT, most: int = TRIE_BYTES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages`` (page_id, url).

    ``rule`` is null where none fits, and the verdict is then ``default``. Null urls and urls without ``://`` have empty
    host and path, which only a rule without host and path could fit. Repeated rows come out repeated.
    """
    spark = pages.sparkSession
    out = pages.select("page_id", F.col("url").cast("string").alias("url"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for part in _parts(rules, most):
        trie = spark.sparkContext.broadcast(compile_trie(part))

        def match(frames: Iterator[pd.DataFrame], trie=trie) -> Iterator[pd.DataFrame]:
            for frame in frames:
                hosts, found = [split_url(u) for u in frame["url"]], []
                for (host, path), old_rule, old in zip(hosts, frame["rule"], frame["verdict"]):
                    best = longest(trie.value, host, path)
                    if old_rule is not None:
                        best = _better((old_rule, old), *best) if best else (old_rule, old)
                    found.append(best or (None, None))
                frame["host"], frame["path"] = [h for h, _ in hosts], [p for _, p in hosts]
                frame["rule"], frame["verdict"] = [r for r, _ in found], [v for _, v in found]
                yield frame

        out = out.select("page_id", "url", "rule", "verdict").mapInPandas(match, "page_id bigint, url string, rule string, verdict string, host string, path string")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
