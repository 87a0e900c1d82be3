"""URL filters: weighted URL vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in a lower-cased url. A hit
counts if letters and digits do not continue it on either side. One strict term rejects;
soft terms reject when their distinct hits reach `soft_limit`. Rules on host and path
overrule the vocabulary: the longest rule that fits decides.

The vocabulary is a parameter: any list of terms and weights, for example from a table
(`read_vocabulary`). The default one has words of five topics; the plurals of soft ones
follow from a rule and count as the same word.

Defined cases: a null url or one without `://` has an empty host and path and no rule; a
null or empty url is allowed; a url is searched whole, however long; repeated rows are
judged alike; a null page_id is passed on; an empty table gives an empty result; columns
other than page_id and url are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

STRICT = (
    # adult
    "bdsm", "escort", "escorts", "hentai", "nsfw", "porn", "porno", "pornhub", "pornography", "redtube", "upskirt",
    "xnxx", "xvideos", "xxx", "youporn",
    # gambling
    "baccarat", "casino", "roulette", "sportsbook",
    # pharmacy
    "cialis", "levitra", "phentermine", "tramadol", "viagra", "xanax",
    # spam
    "keygen", "warez",
    # advertising
    "adserver", "adservice", "clickbank", "doubleclick",
)
SOFT = (
    # adult
    "adult", "babe", "cam", "dating", "erotic", "fetish", "hot", "hookup", "milf", "naked", "nude", "sex", "sexy",
    "single", "teen", "webcam",
    # gambling
    "bet", "betting", "bingo", "blackjack", "bonus", "gambling", "jackpot", "lottery", "odds", "poker", "slot", "wager",
    # pharmacy
    "cheap", "diet", "drug", "drugstore", "generic", "pharmacy", "pill", "prescription", "rx", "steroid", "supplement",
    # spam
    "cash", "click", "crack", "deal", "discount", "earn", "farm", "free", "loan", "offer", "payday", "prize", "promo",
    "replica", "seo", "spam", "torrent", "unsubscribe", "win", "winner",
    # advertising
    "ad", "affiliate", "banner", "beacon", "impression", "pixel", "popup", "redirect", "sponsor", "track", "tracker",
    "tracking",
)
SOFT_LIMIT = 2


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

def plural(word: str) -> str:
    """The regular English plural."""
    if word.endswith("y") and word[-2:-1] not in tuple("aeiou"):
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "z", "ch", "sh")) else "s")


def read_vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table (term, strict). It must fit an automaton in a worker's
    memory: lists of up to some 100,000 terms."""
    rows = terms.where("term is not null and term <> ''").select("term", "strict").distinct().collect()
    return tuple(tuple(sorted(t.translate(_UPPER) for t, hard in rows if bool(hard) is kind)) for kind in (True, False))


_UPPER = {i: i + 32 for i in range(65, 91)}
_AFTER_HOST, _AFTER_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")


def host_and_path(url: str | None) -> tuple[str, str]:
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    m = _AFTER_HOST.search(rest[2])
    at = m.start() if m else len(rest[2])
    return rest[2][:at].translate(_UPPER), _AFTER_PATH.split(rest[2][at:], maxsplit=1)[0]


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    forms = {plural(w): (w, False) for w in soft} | {w: (w, False) for w in soft} | {w: (w, True) for w in strict}
    for form, meaning in forms.items():
        a.add_word(form, (form, *meaning))
    a.make_automaton()
    return a


def term_hits(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[set, set]:
    """Distinct strict and soft terms that stand alone between non-alphanumerics; soft ones also in the plural."""
    text = (url or "").translate(_UPPER)
    found: tuple[set, set] = set(), set()
    automaton = _automaton(strict, soft)
    if not text or not len(automaton):
        return found
    for end, (form, word, is_strict) in automaton.iter(text):
        begin = end - len(form) + 1
        if (not begin or not text[begin - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            found[0 if is_strict else 1].add(word)
    return found


class Ruleset:
    """Longest fitting rule by a walk over the host's suffixes: a lookup for each label,
    however many rules there are."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, []).append(r)

    def find(self, host: str, path: str) -> Rule | None:
        best = None
        while host:
            for r in self.by_host.get(host, ()):
                if path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
                    best = r
            host = host.partition(".")[2]
        return best


def url_filter(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft (distinct terms) for every row."""

    def run(batches):
        ruleset = Ruleset(rules)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                hard, mild = term_hits(url, strict, soft)
                rule = ruleset.find(host, path)
                own = "block" if hard or len(mild) >= soft_limit else "allow"
                out.append((host, path, rule and rule.text, rule.verdict if rule else own, len(hard), len(mild)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"],
            )

    return pages.select("page_id", "url").mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _count(words: Sequence[str], plurals: bool = False) -> str:
    forms = [f"({w}|{plural(w)})" if plurals else w for w in words]
    return " + ".join(rf"cast(regexp_matches(u, '(^|[^\p{{L}}\p{{N}}]){x}($|[^\p{{L}}\p{{N}}])') as bigint)" for x in forms)


ORACLE_SQL = (
    r"""
with s as (
  select page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as u,
         case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages),
h as (
  select page_id, u,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from s),
r as (
  select *, case
      when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule,
"""
    f"    cast({_count(STRICT)} as bigint) as n_strict,\n    cast({_count(SOFT, plurals=True)} as bigint) as n_soft\n  from h)\n"
    f"""
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            when n_strict > 0 or n_soft >= {SOFT_LIMIT} then 'block' else 'allow' end as verdict,
       n_strict, n_soft
from r
"""
)
