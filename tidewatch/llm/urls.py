"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import fresh, table


@dataclass(frozen=True)
class Vocabulary:
    """One strict term rejects a url; so do `soft_least` different soft terms. Terms stand between characters other than a-z and 0-9."""

    strict: tuple[str, ...]
    soft: tuple[str, ...]
    soft_least: int = 2


# Terms.
TERMS = Vocabulary(
    strict=("casino", "escort", "gambling", "hentai", "jackpot", "porn", "porno", "spam", "sportsbet", "viagra", "warez", "xxx"),
    soft=("adult", "bet", "bonus", "cam", "cheap", "crack", "dating", "discount", "farm", "free", "keygen", "loan", "lottery", "pharma", "pills", "poker", "sex", "slots", "torrent", "win", "winner"),
)


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Hosts, paths and verdicts of the rules.
RULES = (
    HostRule("com", "/en/", "block"),
    HostRule("example.com", "/en/7", "allow"),
    HostRule("net", "/de/", "allow"),
    HostRule("example.net", "/de/8", "block"),
    HostRule("org", "/es/", "block"),
)
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _A, _Z)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[HostRule, ...], give) -> Column:
    """give(rule) of the longest rule that fits the host or a parent domain of it and starts the path."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(give(r))).otherwise(out)
    return out


def vocabulary_hits(terms: Vocabulary):
    """A UDF: url -> how many different strict and soft terms it holds, in one pass over the url."""

    def apart(c: str) -> bool:
        return not ("a" <= c <= "z" or "0" <= c <= "9")

    @F.pandas_udf("strict int, soft int")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for weight, words in enumerate((terms.strict, terms.soft)):
            for w in words:
                machine.add_word(w, (weight, w))
        machine.make_automaton()
        lower = str.maketrans(_A, _Z)

        def count(url: str | None) -> tuple[int, int]:
            found: tuple[set, set] = (set(), set())
            low = (url or "").translate(lower)
            for last, (weight, w) in machine.iter(low):
                first = last - len(w) + 1
                if (first == 0 or apart(low[first - 1])) and (last + 1 == len(low) or apart(low[last + 1])):
                    found[weight].add(w)
            return len(found[0]), len(found[1])

        for urls in parts:
            yield pd.DataFrame([count(u) for u in urls], columns=["strict", "soft"], dtype="int32")

    return hits


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[HostRule, ...] = RULES, terms: Vocabulary = TERMS) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block) of each url.

    A null url, or one without ://, has an empty host and path, so no rule fits; the vocabulary
    still judges what text there is, and null is allowed. Urls of any length are read whole;
    repeated rows are judged alike; an empty table gives an empty one; columns of the same names
    as the results are replaced.
    """
    (seen,) = fresh(pages, "_hits")
    own = F.col(url)
    out = pages.withColumn(seen, vocabulary_hits(terms)(own))
    host, path = host_of(own), path_of(own)
    by_rule = rule_of(host, path, rules, lambda r: r.verdict)
    by_terms = F.when((F.col(seen)["strict"] >= 1) | (F.col(seen)["soft"] >= terms.soft_least), "block").otherwise("allow")
    return out.withColumns({"host": host, "path": path, "rule": rule_of(host, path, rules, lambda r: r.name), "verdict": F.coalesce(by_rule, by_terms)}).drop(seen)


def op3_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    longest = sorted(RULES, key=lambda r: -len(r.name))
    case = lambda give: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{give(r)}'" for r in longest) + " END"
    has = lambda words: f"regexp_matches(low, '(^|[^a-z0-9])({words})($|[^a-z0-9])')"
    soft = " + ".join(f"CAST({has(w)} AS INT)" for w in TERMS.soft)
    return f"""
WITH p AS (
  SELECT page_id, {low} AS low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, {case(lambda r: r.name)} AS rule,
  coalesce({case(lambda r: r.verdict)}, CASE WHEN {has("|".join(TERMS.strict))} OR {soft} >= {TERMS.soft_least} THEN 'block' ELSE 'allow' END) AS verdict
FROM p"""


SQL = _sql()
