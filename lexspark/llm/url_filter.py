"""URL filter: host and path rules first, else a weighted vocabulary matched by Aho-Corasick with boundary checks."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, rule): the rule's host is the part before its first slash, its path the rest from that slash on.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: One of these is enough to reject a URL.
STRICT = ("casino", "escort", "hentai", "porn", "sportsbook", "viagra", "warez", "xxx")
#: It takes SOFT_HITS different ones of these.
SOFT = (
    "adult", "bet", "bonus", "cheap", "cialis", "click", "crack", "deal", "farm", "free", "hot", "jackpot", "keygen",
    "loan", "pharma", "pills", "poker", "replica", "sex", "spam", "torrent", "win",
)
SOFT_HITS = 2

SCHEMA = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int"


class Judge:
    """Verdicts for single URLs; built once for each task."""

    def __init__(self, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((f"/{path}", action, rule))
        self.most_labels = max((h.count(".") + 1 for h in self.by_host), default=0)
        self.soft_hits = soft_hits
        self.automaton = ahocorasick.Automaton()
        for word, weight in [*((w, 0) for w in soft), *((w, 1) for w in strict)]:
            self.automaton.add_word(word, (weight, word))
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def parts(url: str | None) -> tuple[str, str]:
        """Host (A-Z lower-cased) and path."""
        _, mark, rest = (url or "").partition("://")
        if not mark:
            return "", ""
        end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        path_end = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
        return _lower(rest[:end]), rest[end:path_end]

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits; of rules as long, the one of the longer host, then block."""
        fits, labels = [], host.rsplit(".", self.most_labels)
        for n in range(1, min(len(labels), self.most_labels) + 1):
            at = ".".join(labels[-n:])
            for start, action, rule in self.by_host.get(at, ()):
                if path.startswith(start):
                    fits.append((len(rule), len(at), action == "block", action, rule))
        return max(fits)[3:] if fits else None

    def hits(self, url: str) -> tuple[int, int]:
        """Numbers of different strict and soft terms that stand between characters other than a-z, A-Z and 0-9."""
        if not len(self.automaton):
            return 0, 0
        text = _lower(url)
        found = set()
        for end, (weight, word) in self.automaton.iter(text):
            before, after = end - len(word), end + 1
            if (before < 0 or not _joins(text[before])) and (after == len(text) or not _joins(text[after])):
                found.add((weight, word))
        strict = sum(weight for weight, _ in found)
        return strict, len(found) - strict

    def __call__(self, url: str | None) -> tuple:
        host, path = self.parts(url)
        strict, soft = self.hits(url or "")
        ruled = self.rule(host, path)
        verdict = ruled[0] if ruled else "block" if strict or soft >= self.soft_hits else "allow"
        return host, path, ruled[1] if ruled else None, verdict, strict, soft


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


def _joins(c: str) -> bool:
    return c.isascii() and c.isalnum()


def judged(url: Column, **options) -> Column:
    """A struct of host, path, rule, verdict, strict_hits and soft_hits."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(**options)
        for urls in batches:
            yield pd.DataFrame([judge(u) for u in urls], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run(url)


def filter_urls(pages: DataFrame, url: str = "url", **options) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), strict_hits and soft_hits.

    A rule fits its host and all subdomains of it if the path starts with the rule's; the longest decides. Without a
    fitting rule, one strict term or SOFT_HITS different soft terms block, as whole words anywhere in the URL. Null
    URL or none with "://": host and path empty; its text is still searched for terms. Empty table: empty result.
    Columns named like the new ones are replaced.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    keep = [c for c in pages.columns if c.lower() not in names or c == url]
    out = pages.select(*keep, judged(F.col(url), **options).alias("__judged"))
    return out.select(*keep, *[F.col(f"__judged.{n}").alias(n) for n in names])
