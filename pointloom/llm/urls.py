"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

The model is fitted to a small labelled table of URLs (at most `rows` of them, taken by hash), so training takes place on
the driver; scoring is one pass over the URLs, whose other columns stay in the JVM. A null URL, or one without "://", has
empty host and path: no rule fits, and the model scores the empty pair. Repeated rows give equal verdicts; other columns
pass through, whatever their names. Without labelled rows every score is 0.5; without rules the model decides alone.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS, SIZES = 1 << 12, (2, 3, 4)
#: Labelled rows that a fit may take.
FIT_ROWS = 12_000

#: Words of hosts that are to be blocked and of ordinary ones; the labelled table is made of them. Ours: gambling, medicines
#: by post, sexual content, advertising and tracking, lures, forged goods and credit, and against them everyday nouns.
BAD = (
    "casino casinos betting sportsbet gamble gambler poker slots roulette jackpot blackjack bingo lottery wager bookmaker winner winning wins bonus bonuses spins "
    "pill pillshop viagra cialis pharma pharmacy meds tramadol steroids slimming diet cheaper cheapest cheapmeds discount discounts coupon "
    "adults adultcam porn porno sex sexy xxx cams webcam escort hookup nude milf fetish hentai "
    "adserver adsense advert adverts banner popup popunder clicks clickbait tracker trackers tracking pixel retarget affiliate traffic redirect "
    "freebie freebies freegift giveaway prize prizes reward rewards claim lucky voucher survey spins crypto bitcoin forex airdrop doubler invest "
    "replica replicas rolex handbags outlet wholesale warez keygen crack cracked torrent serial nulled cheats "
    "loan loans payday credit debt refinance mortgage spammer spamming spambot linkfarm farming botnet seo backlinks phish login-verify malware"
).split()
GOOD = (
    "library news garden weather docs museum recipes university shop thermal mountain forum travel wiki photos hospital maps code theatre "
    "science river music history school market bakery energy city water thread tower harbour letter station stone village winter theory "
    "nation motion question ocean garage mother brother north south earth health youth truth growth thing thank there where white wheel "
    "ship shelter fashion shadow kitchen teacher paper pepper summer dinner table cable noble island hand friend border order animal "
    "painting building morning evening string spring orange bridge cottage yellow window pillow account archive atlas author balance "
    "basket beacon bicycle camera canvas carpet castle ceramic chapel children chorus climate clinic coast college compass concert "
    "country culture desert doctor drawing engine factory family festival field flower forest fruit gallery glacier grammar guitar "
    "journal justice language lantern lesson machine meadow measure medicine memory mirror mobile nature needle network notebook"
).split()

#: Rules as host and path, and what they decide; they fit the host, its subdomains and the paths that begin so.
RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


def labelled_rows(bad: list[str] = BAD, good: list[str] = GOOD) -> list[tuple[str, int]]:
    """Small table of URLs, 1 to be blocked: each word alone and before each of the next three, under turning subdomains,
    domains and paths that tell nothing."""
    out = []
    for label, words in ((1, bad), (0, good)):
        for i, w in enumerate(words):
            hosts = [w, *(f"{w}-{words[(i + k) % len(words)]}" for k in (1, 2, 3))]
            for k, host in enumerate(hosts):
                sub, domain, folder = ("", "www.", "m.", "blog.")[(i + k) % 4], ("com", "org", "net")[(i + 2 * k) % 3], ("en", "de", "fr", "es")[(2 * i + k) % 4]
                out.append((f"https://{sub}{host}.example.{domain}/{folder}/{(i * 131 + k * 977) % 9973}", label))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end."""
    u = F.col(url) if isinstance(url, str) else url
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its decision; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


@lru_cache(1 << 17)
def _slot(gram: str) -> int:
    return int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % SLOTS


def slots(host: str, path: str) -> list[int]:
    """Slots of the distinct n-grams of host and path, which are marked apart."""
    found = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            found.update(mark + s[i : i + n] for i in range(len(s) - n + 1))
    return [_slot(g) for g in found]


def train(rows: list[tuple[str, str, int]], rounds: int = 1500, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Weights of the slots, the last for the constant; full-batch gradient steps over rows of host, path and label."""
    w = np.zeros(SLOTS + 1)
    if not rows:
        return w
    found = [slots(h, p) for h, p, _ in rows]
    count = np.array([len(f) for f in found])
    row, slot, value = np.repeat(np.arange(len(rows)), count), np.concatenate(found), np.repeat(count**-0.5, count)
    y = np.array([r[2] for r in rows], float)
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-(np.bincount(row, w[slot] * value, len(rows)) + w[-1]))) - y
        w -= rate * (np.r_[np.bincount(slot, off[row] * value, SLOTS), off.sum()] / len(rows) + decay * w)
    return w


def fit(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = FIT_ROWS) -> np.ndarray:
    """Weights from at most `rows` labelled URLs; null URLs and labels are left out, repeated rows count once."""
    host, path = host_and_path(url)
    known = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label).cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(rows).collect()
    return train(sorted((r["host"], r["path"], r["label"]) for r in chosen))


def score(host: Column, path: Column, weights: np.ndarray) -> Column:
    """The model's probability of block."""

    @F.pandas_udf("double")
    def scored(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for h, p in zip(hosts, paths):
            found = slots(h, p)
            out.append(1 / (1 + np.exp(-(weights[found].sum() / len(found) ** 0.5 + weights[-1]))))
        return pd.Series(out, dtype=float)

    return scored(host, path)


def judge(pages: DataFrame, weights: np.ndarray, url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages' rows with host, path, rule, score and verdict added (names it replaces if taken); verdict: the rule's, else
    block where the score is at least 0.5, else allow."""
    names = pages.columns
    plain = pages.toDF(*[f"c{i}" for i in range(len(names))])
    host, path = host_and_path(F.col(f"c{names.index(url)}"))
    made = plain.withColumns({"host": host, "path": path}).withColumn("score", score(F.col("host"), F.col("path"), weights))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    made = made.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))})
    new = ("host", "path", "rule", "score", "verdict")
    old = [i for i, c in enumerate(names) if c not in new]
    return made.select(*[f"c{i}" for i in old], *new).toDF(*[names[i] for i in old], *new)


@cache
def default_weights() -> np.ndarray:
    """Of the model that `fit` gives for the small labelled table."""
    split = lambda u: u.split("://", 1)[1].partition("/")
    return train(sorted((h, "/" + p, label) for u, label in labelled_rows() for h, _, p in [split(u)]))


def oracle_sql() -> str:
    """Rules and the model of the small labelled table as DuckDB SQL; the weights are data."""
    w = default_weights()
    parts = ", ".join(f"({i}, {v!r})" for i, v in enumerate(w[:-1].tolist()) if v)
    grams = " || ".join(f"list_transform(range(1, length({c}) - {n - 2}), lambda i: '{m}' || substring({c}, i, {n}))" for m, c in (("h", "eh"), ("p", "ep")) for n in SIZES)
    cases = {k: " ".join(f"WHEN (h.host = '{d}' OR ends_with(h.host, '.{d}')) AND starts_with(h.path, '/{p}') THEN '{(d + '/' + p) if k == 'rule' else v}'" for d, _, p, v in sorted(((*r.partition("/"), v) for r, v in RULES), key=lambda x: -len(x[0] + x[2]))) for k in ("rule", "verdict")}
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path, '^' || host || '$' AS eh, '^' || path || '$' AS ep FROM h),
g AS (SELECT host, path, unnest(list_distinct({grams})) AS gram FROM d),
w(slot, weight) AS (VALUES {parts}),
m AS (SELECT host, path, coalesce(sum(weight), 0) / sqrt(count(*)) + {float(w[-1])!r} >= 0 AS bad FROM g LEFT JOIN w ON slot = CAST('0x' || substring(md5(gram), 1, 8) AS BIGINT) % {SLOTS} GROUP BY ALL)
SELECT page_id, h.host, h.path, CASE {cases["rule"]} END AS rule, coalesce(CASE {cases["verdict"]} END, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN m ON m.host = h.host AND m.path = h.path"""
