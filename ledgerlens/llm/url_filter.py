"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted in this process from a small labelled URL table (at most ``MAX_LABELLED``
rows, the bound on what fitting reads); its weights are whole millionths, so that sums do not
depend on their order and SQL elsewhere reproduces every score.  Judging a table is one
projection of built-in functions: no shuffle, no Python.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and gets the model's verdict on its bias alone; repeated rows are judged alike; an empty table gives
an empty one; very long urls are judged whole; other columns stay, but columns named host, path,
rule, logit or verdict are replaced.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule strings (host, then path) and their verdicts.
DEFAULT_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A rule list is compiled into the plan and therefore bounded.
MAX_RULES = 1000
MAX_LABELLED = 5000
BUCKETS = 2048
GRAM = 3
MICRO = 1_000_000

_WANTED_HOSTS = "news.city-daily.example library.state.example museum.example docs.pyproject.example www.university.example school.example recipes.example weather.example blog.gardening.example shop.books.example m.transport.example health.gov.example maps.example wiki.history.example science.journal.example forum.cycling.example music.archive.example www.theatre.example en.dictionary.example photo.club.example".split()
_UNWANTED_HOSTS = "casino-win.example www.casino-royal.example free-bets.example m.best-bets.example cheap-pills.example www.cheap-meds.example spam-farm.example link-farm.example ads-track.example track-clicks.example adult-x.example www.xxx-adult.example win-casino.example pills-shop.example bets-win.example blog.spam-links.example click-ads.example adult-cams.example free-spins.example cheap-loans.example".split()
_WANTED_PATHS = "/en/12 /fr/300/ /de/48.html /es/77 /articles/2021/rain /about /en/905/ /fr/61.html".split()
_UNWANTED_PATHS = "/en/44 /win/now /fr/910.html /buy/cheap /es/8/ /free/bonus /de/71 /click/track".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (1: block): every listed host with two of the listed paths of its kind."""
    out = []
    for hosts, paths, label in ((_WANTED_HOSTS, _WANTED_PATHS, 0), (_UNWANTED_HOSTS, _UNWANTED_PATHS, 1)):
        for i, host in enumerate(hosts):
            out += [(f"https://{host}{paths[(i + k) % len(paths)]}", label) for k in (0, 3)]
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the columns have them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def buckets_of(host: str, path: str) -> list[int]:
    """The buckets of all n-grams, hosts with their ends marked, paths with their start marked."""
    out = []
    for seed, text in ((1, f"^{host}$" if host else ""), (2, f"|{path}" if path else "")):
        for i in range(len(text) - GRAM + 1):
            h = seed
            for c in text[i : i + GRAM]:
                h = (h * 8191 + ord(c)) % 1_000_003
            out.append(h % BUCKETS)
    return out


@lru_cache(maxsize=8)
def fit(labelled: tuple[tuple[str, int], ...], epochs: int = 200, rate: float = 0.5, l2: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """Bias and bucket weights in millionths, by gradient descent over the labelled table."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled rows")
    rows = [(buckets_of(*split_url(u)), y) for u, y in labelled]
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        grad, grad_bias = {}, 0.0
        for x, y in rows:
            z = bias + sum(w[b] for b in x)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            grad_bias += g
            for b in x:
                grad[b] = grad.get(b, 0.0) + g
        bias -= rate * grad_bias / max(1, len(rows))
        for b, g in grad.items():
            w[b] -= rate * (g / len(rows) + l2 * w[b])
    return round(bias * MICRO), tuple(round(x * MICRO) for x in w)


def host_of(url: Column) -> Column:
    rest = F.expr("substring(__url, instr(__url, '://') + 3)")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.when(url.contains("://"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring(__url, instr(__url, '://') + 3)")
    return F.when(url.contains("://"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _grams(seed: int, text: Column, weights: Column) -> Column:
    """The sum of the weights of the n-grams of a marked text."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("long"))

    def weight(codes: Column, i: Column) -> Column:
        h = F.lit(seed).cast("long")
        for k in range(GRAM):
            h = (h * 8191 + codes[i + k]) % 1_000_003
        return weights[(h % BUCKETS).cast("int")]

    # one-element array: the code points are computed once
    return F.transform(F.array(codes), lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - GRAM), F.lit(0).cast("long"), lambda a, i: a + weight(c, i)))[0]


def rule_matches(host: Column, path: Column, rule: str) -> Column:
    """Whether the rule fits the host or a domain above it and the start of the path."""
    domain, _, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)


def filter_urls(df: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = DEFAULT_RULES, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """Add host, path, rule (the longest that fits, else null), logit (millionths) and verdict ('allow' or 'block')."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; join them by host instead")
    bias, weights = fit(tuple(labelled if labelled is not None else labelled_urls()))
    table = F.expr("array(" + ", ".join(f"{w}L" for w in weights) + ")")
    df = df.withColumn("__url", F.coalesce(df[url].cast("string"), F.lit("")))
    df = df.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url")))
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        rule = F.when(rule_matches(host, path, text), text).otherwise(rule)
        verdict = F.when(rule_matches(host, path, text), what).otherwise(verdict)
    logit = F.lit(bias).cast("long")
    for seed, text, there in ((1, F.concat(F.lit("^"), host, F.lit("$")), F.length(host) > 0), (2, F.concat(F.lit("|"), path), F.length(path) >= GRAM - 1)):
        logit = logit + F.when(there, _grams(seed, text, table)).otherwise(0)
    return df.withColumn("rule", rule).withColumn("logit", logit).withColumn("verdict", F.coalesce(verdict, F.when(F.col("logit") > 0, "block").otherwise("allow"))).drop("__url")


def oracle() -> str:
    """DuckDB SQL for the default rules and table."""
    bias, weights = fit(tuple(labelled_urls()))

    def grams(seed: int, text: str, there: str) -> str:
        h = f"{seed}::BIGINT"
        for k in range(GRAM):
            h = f"(({h}) * 8191 + unicode(substr({text}, i + {k}, 1))) % 1000003"
        return f"CASE WHEN {there} THEN list_sum(list_transform(range(1, length({text}) - {GRAM - 2}), lambda i: w[(({h}) % {BUCKETS}) + 1])) ELSE 0 END"

    ordered = sorted(DEFAULT_RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = {t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')" for t, _ in ordered}
    rule = "CASE " + " ".join(f"WHEN {fits[t]} THEN '{t}'" for t, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[t]} THEN '{v}'" for t, v in ordered) + " WHEN logit > 0 THEN 'block' ELSE 'allow' END"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         {list(weights)}::BIGINT[] AS w
  FROM cut),
scored AS (
  SELECT page_id, host, path, ({bias} + {grams(1, "('^' || host || '$')", "length(host) > 0")} + {grams(2, "('|' || path)", f"length(path) >= {GRAM - 1}")})::BIGINT AS logit
  FROM parts)
SELECT page_id, host, path, {rule} AS rule, logit, {verdict} AS verdict FROM scored"""
