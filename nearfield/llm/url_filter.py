"""URL filters: host and path rules first, then a weighted vocabulary searched by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import LOWER, UPPER, lower_ascii

# Fixed values: (host, path prefix, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Terms of which one is enough to reject a url.
STRICT_STEMS = (
    "porn", "porno", "xxx", "xvideo", "hentai", "camgirl", "warez", "keygen", "malware", "phishing", "escort", "milf", "upskirt", "incest", "bukkake",
    "gangbang", "blowjob", "cumshot", "rape", "carding", "ransomware", "botnet", "crackz", "serialz", "nulled", "stresser", "booter", "fullz",
)
# Terms that reject together only, by weight.
SOFT_STEMS = {
    1: ("adult", "dating", "crack", "loan", "credit", "slot", "bonus", "replica", "torrent", "download", "cheap", "discount", "free", "win", "prize", "lottery", "model", "webcam", "chat", "pill",
        "pharmacy", "diet", "keto", "crypto", "forex", "trading", "invest", "rich", "cash", "coupon", "vip", "tattoo", "gossip", "celeb", "lingerie", "bikini", "massage", "single", "swinger", "beer"),
    2: ("sexy", "nude", "casino", "betting", "poker", "jackpot", "payday", "hookup", "viagra", "cialis", "roulette", "blackjack", "baccarat", "sportsbook", "bookmaker", "levitra", "tramadol", "xanax",
        "steroid", "cannabis", "vape", "gun", "rifle", "ammo", "fetish", "bdsm", "erotic", "topless", "striptease", "onlyfans", "camshow", "sugardaddy", "proxy", "unblock", "spyware", "cheat"),
    3: ("sex", "naked", "boob", "bitcoindoubler", "gambling", "pornstar", "livecam", "oxycontin", "fentanyl", "counterfeit", "fakeid", "darknet", "hitman", "exploitkit"),
}


def forms(stem: str) -> tuple[str, str]:
    """A term and its plural."""
    return stem, stem + ("es" if stem.endswith(("s", "x", "z", "ch")) else "s")


#: One of these is enough to reject a url.
STRICT = tuple(f for stem in STRICT_STEMS for f in forms(stem))
#: Weights of terms that only reject together.
SOFT = {f: weight for weight, stems in SOFT_STEMS.items() for stem in stems for f in forms(stem)}


@dataclass(frozen=True)
class Vocabulary:
    """Terms are matched in lower case. Distinct soft terms reject if there are at least `several` and their weights' sum is min_soft or more."""

    strict: Sequence[str] = STRICT
    soft: dict[str, int] = field(default_factory=lambda: dict(SOFT))
    min_soft: int = 4
    several: int = 2


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits; a CASE chain, longest rule first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _searcher(vocabulary: Vocabulary):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, terms in (("strict", vocabulary.strict), ("soft", vocabulary.soft)):
        for term in terms:
            automaton.add_word(term, (kind, term))
    automaton.make_automaton()
    weight = vocabulary.soft

    def hits(url: str | None) -> tuple[int, int, int]:
        text, strict, soft = lower_ascii(unquote(url or "")), set(), set()
        for end, (kind, term) in automaton.iter(text):
            start = end - len(term) + 1
            if (start and text[start - 1].isalnum()) or text[end + 1 : end + 2].isalnum():
                continue  # inside a longer word
            (strict if kind == "strict" else soft).add(term)
        return len(strict), len(soft), sum(weight[t] for t in soft)

    return hits


def vocabulary_hits(url: Column, vocabulary: Vocabulary) -> Column:
    """struct(n_strict, n_soft, soft_weight): distinct strict terms, distinct soft terms, and the latter's weights' sum.

    Percent-encoded bytes are decoded before the search. A term counts only where no letter or digit stands next to it.
    """

    @F.pandas_udf("n_strict long, n_soft long, soft_weight long")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hits = _searcher(vocabulary)
        for urls in batches:
            yield pd.DataFrame([hits(u) for u in urls], columns=["n_strict", "n_soft", "soft_weight"], dtype="int64")

    return search(url)


def url_verdicts(
    pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", vocabulary: Vocabulary | None = None, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """Judge every url by the longest fitting rule, else by the vocabulary; one row per input row.

    A null url or one without :// has an empty host and path and fits no rule; the vocabulary still sees its text
    (null: no hits, so allow). Repeated rows give repeated results, an empty table an empty one. Other columns
    of the input are ignored, whatever their names.
    """
    v = vocabulary or Vocabulary()
    base = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("_url"))
    base = base.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), vocabulary_hits(F.col("_url"), v).alias("_hits"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_terms = F.when((F.col("_hits.n_strict") >= 1) | ((F.col("_hits.n_soft") >= v.several) & (F.col("_hits.soft_weight") >= v.min_soft)), "block").otherwise("allow")
    return base.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_terms).alias("verdict"), "_hits.n_strict", "_hits.n_soft", "_hits.soft_weight")
