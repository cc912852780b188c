"""URL rules: a broadcast trie over reversed host labels and path segments, longest match wins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: A rule list above this size is refused: the trie is broadcast, so its size must be bounded.
MAX_RULES = 1_000_000

_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url):
    """(host, path) of a url column. Host: after the first "://" up to "/", "?", "#" or the end, A-Z
    lower-cased; path: what follows up to "?", "#" or the end. Null, or no "://": both empty."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)") if isinstance(url, str) else None
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


class UrlTrie:
    """Nested dicts: reversed host labels first, then whole path segments. What a rule's path holds after its last "/"
    is a beginning of a segment, kept in its node's "ends"; a rule without "/" is its node's "any"."""

    def __init__(self, rules: list[tuple[str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
        self.root: dict = {}
        for verdict, rule in sorted(rules, reverse=True):  # of equal rules "allow" comes last, and wins
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.setdefault(("h", label), {})
            if not slash:
                node["any"] = (rule, verdict)
                continue
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            node.setdefault("ends", {})[tail] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest fitting rule, by characters; of equally long ones that with more host labels."""
        best: tuple[str | None, str | None] = (None, None)
        node = self.root
        segments = path[1:].split("/") if path.startswith("/") else None
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            found = self._path(node, segments)
            if found and len(found[0]) >= len(best[0] or ""):
                best = found
        return best

    @staticmethod
    def _path(node: dict, segments: list[str] | None):
        """The longest rule at a host: whole segments one by one, and at each the longest beginning of the next, whatever the number of rules."""
        found = node.get("any")
        for segment in segments or ():
            if ends := node.get("ends"):
                for n in range(len(segment), -1, -1):
                    if (own := ends.get(segment[:n])) is not None:
                        found = own
                        break
            node = node.get(("p", segment))
            if node is None:
                break
        return found


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict added (earlier columns of those names are replaced).

    A rule "host/path" fits its host and all subdomains if the url's path starts with the rule's path;
    the longest wins, by characters (of equally long ones that with more host labels, of equal ones "allow"). A url that no rule fits gets rule null and the default verdict. A null url, or one
    without "://", has an empty host and path. Repeated rows are judged each; an empty table stays so.
    One pass over the rows, no shuffle; the trie is broadcast, its size bounded by MAX_RULES.
    """
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        return pd.DataFrame([match(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], dtype=object)

    host, path = split_url(url)
    (judged,) = unused(df.columns, "_judged")
    out = df.withColumns({"host": host, "path": path}).withColumn(judged, judge("host", "path"))
    out = out.withColumns({"rule": F.col(f"{judged}.rule"), "verdict": F.coalesce(F.col(f"{judged}.verdict"), F.lit(default))})
    return out.drop(judged)
