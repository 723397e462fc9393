"""URL filters by a weighted vocabulary.

One Aho-Corasick pass over a URL finds all terms; a term counts where no letter or digit adjoins it. One strict term,
or several different soft ones, reject the URL. Host rules, where one fits, come first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, workers_find_us

#: Vocabulary of unwanted sites. A strict term suffices; soft ones are ordinary words that count together.
STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "escort", "spam-farm", "link-farm", "warez", "hentai", "camgirls", "payday-loan")
SOFT = ("adult", "bet", "bonus", "bookmaker", "buy", "cheap", "clickbait", "crack", "dating", "discount", "free", "gambling", "hot", "jackpot", "keygen", "loan", "money", "nude", "pharmacy", "pills", "poker", "sex", "slots", "spam", "torrent", "win", "winner")
SOFT_LIMIT = 2


@dataclass(frozen=True)
class Rule:
    """A host rule: verdict for the host and its subdomains, where the path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?', '#' or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls. Rules of equal length: the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):  # the longest outermost
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


_automata: dict[tuple[tuple[str, ...], tuple[str, ...]], object] = {}


def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    if (strict, soft) not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in ((1, soft), (2, strict)):
            for w in words:
                a.add_word(w.lower(), (kind, w.lower()))
        a.make_automaton()
        _automata[strict, soft] = a
    return _automata[strict, soft]


def hits(url: str, automaton) -> tuple[set[str], set[str]]:
    """Different strict and soft terms in url that no ASCII letter or digit adjoins."""
    low = url.translate({i: i + 32 for i in range(65, 91)})
    found: tuple[set[str], set[str]] = (set(), set())
    edge = lambda i: not (0 <= i < len(low) and low[i].isascii() and low[i].isalnum())
    for end, (kind, term) in automaton.iter(low):
        if edge(end + 1) and edge(end - len(term)):
            found[kind == 1].add(term)
    return found


def vocabulary_hits(url: Column, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> Column:
    """struct(strict array, soft array) of the different terms in url, sorted. Null: none."""

    @F.pandas_udf(T.StructType([T.StructField("strict", T.ArrayType(T.StringType())), T.StructField("soft", T.ArrayType(T.StringType()))]))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(strict, soft)
        for urls in batches:
            both = [hits(u or "", automaton) for u in urls]
            yield pd.DataFrame({"strict": [sorted(s) for s, _ in both], "soft": [sorted(s) for _, s in both]})

    return found(F.coalesce(url.cast("string"), F.lit("")))


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = (), strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: page_id, host, path, rule, verdict ('allow' or 'block'), strict_terms, soft_terms.

    The longest fitting rule decides; else the vocabulary: 'block' on one strict or soft_limit different soft terms.
    Null or empty urls, and those without '://', have empty host and path; the vocabulary still reads the whole url.
    Rows keep their number; other columns are left out.
    """
    workers_find_us(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), vocabulary_hits(F.col("url"), strict, soft).alias("hit"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    unwanted = (F.size("hit.strict") >= 1) | (F.size("hit.soft") >= soft_limit)
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(unwanted, "block").otherwise("allow")).alias("verdict"), F.col("hit.strict").alias("strict_terms"), F.col("hit.soft").alias("soft_terms"))
