"""URL filter by a weighted vocabulary, with host and path rules before it.

Host and path of every URL are taken apart by Spark. One Aho-Corasick automaton of
all terms then runs once over them, lower-cased. A hit counts only at its boundaries:
``whole`` terms have no letter or digit on either side, ``edge`` terms none on one
side at least, so that compounds are found but not what lies inside a word. Every
different term counts once, by its weight; strict terms weigh as much as the bound,
soft terms less, so one strict or several different soft terms reject a URL. Query
and fragment are not judged.

A rule names a host, with all its subdomains, and the begin of a path. The longest
rule that fits a URL decides; the vocabulary decides the others.

Defined cases: a null URL and one without ``://`` have an empty host and path, fit no
rule and are allowed; hosts keep user and port; the path of ``http://host`` is empty
and begins with no rule's; of fitting rules of one length the one with the longer
host decides; repeated rows give repeated rows; URLs of any length are read whole; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of URLs that one of suffices to reject, by boundary.
STRICT_WHOLE = "cialis escorts milf nsfw orgy xxx".split()
STRICT_EDGE = "blackjack camgirl casino hentai livesex porn roulette sexcam sexshop viagra warez xvideo".split()
#: Words of which two different ones reject.
SOFT_WHOLE = """
    ad ads adult adults adv advert adverts affiliate affiliates babes backlink backlinks banner banners bet bets betting
    bonus cam cams cheap click clicks coupon coupons crack cracked dating drugs erotic escort farm free gambling girls
    hack hacks hot jackpot keygen loan loans lottery meds naked nude payday pharmacy pill pills poker popup popups prize
    prizes replica seo serial sex sexy singles slot slots spam torrent torrents track tracker tracking win winner winners
    winning x
""".split()


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case with their weight and boundary (``whole`` or ``edge``); URLs whose different
    terms weigh ``bound`` or more are rejected."""

    terms: tuple[tuple[str, int, str], ...]
    bound: int = 2

    def __post_init__(self) -> None:
        wrong = [t for t, _, edge in self.terms if not t or edge not in ("whole", "edge")]
        names = [t for t, _, _ in self.terms]
        if wrong or len(set(names)) < len(names):
            raise ValueError(f"empty or repeated terms, or unknown boundaries: {wrong or names}")


VOCABULARY = Vocabulary(
    tuple((t, 2, "whole") for t in STRICT_WHOLE)
    + tuple((t, 2, "edge") for t in STRICT_EDGE)
    + tuple((t, 1, "whole") for t in SOFT_WHOLE)
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.regexp_extract(url, _PARTS, 2)


class RuleTable:
    """Rules by host, the longest path first."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: -len(r.path)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def longest(self, host: str, path: str) -> Rule | None:
        """The host and what follows each of its dots are looked up, the longest first."""
        best = None
        while host:
            for rule in self.by_host.get(host, ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
            host = host.partition(".")[2]
        return best


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight, boundary in vocabulary.terms:
        found.add_word(term, (term, weight, boundary == "whole"))
    found.make_automaton()
    return found


def hits(searched: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """The different terms at their boundaries, with their weight."""
    found = {}
    for end, (term, weight, whole) in searched.iter(text):
        begin = end + 1 - len(term)
        left = begin == 0 or not text[begin - 1].isalnum()
        right = end + 1 == len(text) or not text[end + 1].isalnum()
        if (left and right) if whole else (left or right):
            found[term] = weight
    return found


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict, soft``: one row per page.

    ``strict`` and ``soft`` list the terms found, also where a rule decides. Rules and
    terms are held by every task: thousands, not a table that grows with the pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RuleTable(rules)
        searched = automaton(vocabulary) if vocabulary.terms else None
        for batch in batches:
            rule, verdict, strict, soft = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("host", "path", "_text"))
            for host, path, text in zip(*columns):
                decides = table.longest(host, path)
                found = hits(searched, text) if searched else {}
                rejected = sum(found.values()) >= vocabulary.bound
                rule.append(decides.text if decides else None)
                verdict.append(decides.verdict if decides else "block" if rejected else "allow")
                strict.append(sorted(t for t, w in found.items() if w >= vocabulary.bound))
                soft.append(sorted(t for t, w in found.items() if w < vocabulary.bound))
            terms = [pa.array(x, pa.list_(pa.string())) for x in (strict, soft)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), *terms],
                names=["page_id", "host", "path", "rule", "verdict", "strict", "soft"],
            )

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("_text", F.concat("host", lower_ascii(F.col("path"))))
    kind = dict(pages.select("page_id").dtypes)["page_id"]
    return parts.mapInArrow(
        run,
        f"page_id {kind}, host string, path string, rule string, verdict string, strict array<string>, soft array<string>",
    )


def report_sql(rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = VOCABULARY) -> str:
    """The judgement as a join of URLs with terms and rules, for another engine."""
    terms = ", ".join(f"('{t}', {w}, {str(b == 'whole').lower()})" for t, w, b in vocabulary.terms)
    named = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return rf"""
WITH term(term, weight, whole) AS (VALUES {terms}),
rules(r_host, r_path, r_verdict) AS (VALUES {named}),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS place
  FROM pages
),
texts AS (SELECT *, host || translate(path, '{_UPPER}', '{_LOWER}') AS judged FROM parts),
found AS (
  SELECT place, sum(weight) FILTER (WHERE regexp_matches(judged,
      CASE WHEN whole THEN '(^|[^\pL\pN])' || term || '([^\pL\pN]|$)'
        ELSE '((^|[^\pL\pN])' || term || '|' || term || '([^\pL\pN]|$))' END)) AS weight
  FROM texts, term GROUP BY place
),
ruled AS (
  SELECT place, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
    arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
  FROM texts, rules
  WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY place
)
SELECT page_id, host, path, rule,
  coalesce(r_verdict, CASE WHEN weight >= {vocabulary.bound} THEN 'block' ELSE 'allow' END) AS verdict
FROM texts JOIN found USING (place) LEFT JOIN ruled USING (place)
"""
