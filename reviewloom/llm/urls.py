"""URL filters: host and path rules first, a weighted vocabulary for the rest.

A rule fits its host and every subdomain if the path starts with the rule's path; of several that fit, the
longest wins. Where none fits, the terms of the vocabulary are looked for in the lower-cased URL in one pass over
it (Aho-Corasick). A term has a weight and a place where it counts:

* ``any``: anywhere, between characters that are neither letters nor digits;
* ``host``: the same, in the host alone, so that an address in a query parameter doesn't count;
* ``label``: a whole label of the host;
* ``inside``: in the host, as a piece of a word too.

One strict term, or ``soft_limit`` different soft ones, reject the URL. Soft are topics, and modifiers, ordinary words which count once
at most and only beside a topic.

A null URL, and one without ``://``, has an empty host and path; no rule fits it, and the vocabulary judges
whatever text there is. Repeated rows are judged alike; other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import bounded

#: (host, path, verdict). Fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Terms by weight and place.
VOCABULARY = {
    ("strict", "any"): [
        "porn", "porno", "pornos", "pornhub", "xxx", "hentai", "nsfw", "x-rated", "xrated", "milf", "milfs", "camgirl", "camgirls",
        "sexcam", "sexcams", "sex-cam", "sex-cams", "sexchat", "sex-chat", "livesex", "sexshop", "sex-shop", "free-sex", "upskirt",
        "blowjob", "creampie", "gangbang", "warez", "keygen", "keygens", "onlinecasino", "casinobonus", "freespins", "sportsbook",
        "sportsbooks", "cheappills", "buyviagra", "buycialis", "paydayloan", "paydayloans", "spamfarm", "spam-farm", "linkfarm", "link-farm",
        "adserver", "adservers", "adtracker", "popunder", "clickfraud",
    ],
    ("strict", "host"): ["casino", "casinos", "gambling", "betting", "viagra", "cialis", "torrents"],
    ("strict", "label"): ["adult", "adults", "sex", "sexy", "nude", "nudes", "bet", "bets", "poker", "slots", "jackpot", "pills", "torrent", "ads"],
    ("strict", "inside"): ["porn", "casino", "hentai", "xxx", "viagra"],
    ("topic", "any"): [
        "casino", "casinos", "poker", "betting", "gambling", "roulette", "blackjack", "slots", "jackpot", "viagra", "cialis", "tramadol",
        "xanax", "pills", "torrent", "torrents", "payday", "replica", "replicas", "cracked", "serials", "escort", "escorts", "erotic",
        "erotica", "hookup", "hookups",
    ],
    ("topic", "host"): ["adult", "adults", "sex", "sexy", "nude", "nudes", "bet", "bets", "spam", "ads"],
    ("modifier", "any"): ["bonus", "bonuses", "cheap", "cheapest", "discount", "loan", "loans", "rolex", "spins", "wager"],
    ("modifier", "host"): ["free", "win", "winner", "x", "cam", "cams", "tube", "toys", "track", "tracker", "tracking", "click", "clicks", "banner"],
}
SOFT_LIMIT = 2


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], name: bool) -> Column:
    """The name or the verdict of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, rule_host + rule_path if name else verdict).otherwise(found)
    return found


def automaton(vocabulary: dict[tuple[str, str], list[str]]) -> ahocorasick.Automaton:
    uses: dict[str, list[tuple[str, str]]] = {}
    for use, terms in vocabulary.items():
        for term in terms:
            uses.setdefault(term, []).append(use)
    machine = ahocorasick.Automaton()
    for term, found in uses.items():
        machine.add_word(term, (term, found))
    machine.make_automaton()
    return machine


def host_span(url: str) -> tuple[int, int]:
    """Where the host of a URL is; an empty span if it has none."""
    at = url.find("://")
    if at < 0:
        return 0, 0
    ends = [i for i in (url.find(c, at + 3) for c in "/?#") if i >= 0]
    return at + 3, min(ends, default=len(url))


def hits(machine: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """How many different strict and soft terms a lower-cased URL has in their places."""
    found: dict[str, set[str]] = {"strict": set(), "topic": set(), "modifier": set()}
    first, last = host_span(url)
    for end, (term, uses) in machine.iter(url):
        start, end = end - len(term) + 1, end + 1
        in_host = first <= start and end <= last
        before, after = url[start - 1 : start] if start else "", url[end : end + 1]
        alone = not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum())
        label = in_host and alone and (start == first or before != "-") and (end == last or after != "-")
        fits = {"any": alone, "host": in_host and alone, "label": label, "inside": in_host}
        for weight, place in uses:
            if fits[place]:
                found[weight].add(term)
    topics = len(found["topic"])
    return len(found["strict"]), topics + (1 if topics and found["modifier"] else 0)


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    vocabulary: dict[tuple[str, str], list[str]] = VOCABULARY,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every row of ``pages`` (page_id, url)."""

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(vocabulary)
        for urls in batches:
            yield pd.DataFrame([hits(machine, u) for u in urls], columns=["strict", "soft"])

    bounded(pages.sparkSession)  # the workers import this package
    host, path = parts(F.col("url"))
    lower = F.translate(
        F.coalesce("url", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    judged = pages.select("page_id", "url").select(
        "page_id", host.alias("host"), path.alias("path"), count(lower).alias("hits")
    )
    host, path, bad = F.col("host"), F.col("path"), (F.col("hits.strict") > 0) | (F.col("hits.soft") >= soft_limit)
    return judged.select(
        "page_id",
        "host",
        "path",
        longest_rule(host, path, rules, True).alias("rule"),
        F.coalesce(longest_rule(host, path, rules, False), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.col("hits.strict").alias("strict_hits"),
        F.col("hits.soft").alias("soft_hits"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The statement's own words, stated anew: weight, place, terms.
SQL_TERMS = """
  ('strict', 'any', 'porn porno pornos pornhub xxx hentai nsfw x-rated xrated milf milfs camgirl camgirls sexcam sexcams sex-cam sex-cams sexchat sex-chat livesex sexshop sex-shop free-sex upskirt blowjob creampie gangbang warez keygen keygens onlinecasino casinobonus freespins sportsbook sportsbooks cheappills buyviagra buycialis paydayloan paydayloans spamfarm spam-farm linkfarm link-farm adserver adservers adtracker popunder clickfraud'),
  ('strict', 'host', 'casino casinos gambling betting viagra cialis torrents'),
  ('strict', 'label', 'adult adults sex sexy nude nudes bet bets poker slots jackpot pills torrent ads'),
  ('strict', 'inside', 'porn casino hentai xxx viagra'),
  ('topic', 'any', 'casino casinos poker betting gambling roulette blackjack slots jackpot viagra cialis tramadol xanax pills torrent torrents payday replica replicas cracked serials escort escorts erotic erotica hookup hookups'),
  ('topic', 'host', 'adult adults sex sexy nude nudes bet bets spam ads'),
  ('modifier', 'any', 'bonus bonuses cheap cheapest discount loan loans rolex spins wager'),
  ('modifier', 'host', 'free win winner x cam cams tube toys track tracker tracking click clicks banner')
"""


def filter_sql() -> str:
    """The same in DuckDB: a regular expression per weight and place instead of an automaton.

    Matches of one expression can share their edges, so a URL's words are looked for one by one.
    """
    case = {True: "", False: ""}
    for host, path, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = {_quoted(host)} OR ends_with(host, {_quoted('.' + host)})) AND starts_with(path, {_quoted(path)})"
        case[True] += f" WHEN {fits} THEN {_quoted(host + path)}"
        case[False] += f" WHEN {fits} THEN {_quoted(verdict)}"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH terms AS (SELECT weight, place, unnest(string_split(words, ' ')) AS term FROM (VALUES {SQL_TERMS}) AS v(weight, place, words)),
named AS (
  SELECT url, {lower.format("coalesce(url, '')")} AS u,
         {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM (SELECT DISTINCT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
met AS (
  SELECT DISTINCT n.url, t.weight, t.term FROM named n JOIN terms t ON contains(n.u, t.term) AND CASE t.place
    WHEN 'any' THEN regexp_matches(n.u, '(^|[^a-z0-9])' || t.term || '([^a-z0-9]|$)')
    WHEN 'host' THEN regexp_matches(n.host, '(^|[^a-z0-9])' || t.term || '([^a-z0-9]|$)')
    WHEN 'label' THEN regexp_matches(n.host, '(^|[^a-z0-9-])' || t.term || '([^a-z0-9-]|$)')
    ELSE contains(n.host, t.term) END),
counted AS (
  SELECT url, count(*) FILTER (weight = 'strict') AS strict_hits, count(*) FILTER (weight = 'topic') AS topics,
         count(*) FILTER (weight = 'modifier') AS modifiers FROM met GROUP BY url),
judged AS (
  SELECT n.*, coalesce(strict_hits, 0) AS strict_hits,
         CASE WHEN topics > 0 THEN topics + least(modifiers, 1) ELSE 0 END AS soft_hits
  FROM named n LEFT JOIN counted c ON c.url = n.url)
SELECT page_id, host, path, CASE{case[True]} END AS rule,
       CASE{case[False]} WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits::int AS strict_hits, soft_hits::int AS soft_hits
FROM pages p JOIN judged j ON j.url IS NOT DISTINCT FROM p.url"""
