"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table of URLs and is a plain array of BUCKETS weights, whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

BUCKETS = 1 << 14
#: Lengths of the character n-grams.
LENGTHS = (3, 4, 5)
#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# the labelled table: words of hosts that are unwanted or wanted, paths, and how they are put together
UNWANTED_WORDS = (
    "adserver ads adult affiliate banner betting bingo bonus booty cash casino cheap click counterfeit crack crypto dating deals diet discount earn escort fake followers forex free gambling giveaway hacks "
    "hookup hot instant jackpot keygen lenders loans lottery lucky malware meds miracle money nude payday phish pills poker popunder porn prize replica rich scam sexy singles slots spam stats-pixel sweepstakes "
    "torrentz tracker traffic viagra warez weightloss xxx"
).split()
WANTED_WORDS = (
    "academy almanac archive arts astronomy atlas baker biology books bridge cathedral chemistry choir cinema city clinic college council country cycling daily design dictionary docs economy education engineering essays "
    "family field forest forum garden gazette geography grammar guild health heritage history hospital house insect island journal kitchen lake language law letters library literature market mathematics medicine meteo "
    "mountain museum music nature northern notes observatory opera orchard parish philosophy physics poetry post project railway recipes research review river school science sculpture society sport station stories "
    "studio summit theatre times town trail university valley village weather wiki world writers zoo bibliothek garten schule wissenschaft zeitung nachrichten jardin ecole journaux musee recherche sante biblioteca "
    "ciencia escuela historia noticias universidad"
).split()
PREFIXES = ("", "www.", "m.", "blog.", "en.")
ENDINGS = (".com", ".org", ".net", ".info", ".eu")
PATHS = ("/", "/en/18", "/articles/2019/05", "/index.html", "/de/thema/7", "/p?id=3", "/fr/page/2", "/es/401.html")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table that the model is trained from: each word as a host of its own and joined with two others of its list, under endings and paths that both labels share."""
    rows = []
    for words, label in ((UNWANTED_WORDS, 1), (WANTED_WORDS, 0)):
        for i, w in enumerate(words):
            for j, name in enumerate((w, f"{w}-{words[(3 * i + 7) % len(words)]}", f"{words[(5 * i + 11) % len(words)]}{w}")):
                rows.append((f"https://{PREFIXES[(i + j) % 5]}{name}{ENDINGS[(i + 2 * j) % 5]}{PATHS[(i + 3 * j) % 8]}", label))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path, each text between marks of its own."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        for n in LENGTHS:
            found.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode()) % BUCKETS for i in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def plain_split(url: str) -> tuple[str, str]:
    _, mark, rest = url.partition("://")
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest)) if mark else 0
    host, tail = rest[:cut] if mark else "", rest[cut:] if mark else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail.split("?")[0].split("#")[0]


def train(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; the table's size bounds the work."""
    x = [grams(*plain_split(u)) for u, _ in rows]
    y = np.array([label for _, label in rows], float)
    flat, owner = np.concatenate(x), np.repeat(np.arange(len(x)), [len(g) for g in x])
    scale = 1 / np.sqrt(np.maximum(1, [len(g) for g in x]))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        z = np.bincount(owner, w[flat], len(x)) * scale + b
        miss = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(flat, (miss * scale)[owner], BUCKETS) / len(x) * 10 + l2 * w)
        b -= rate * miss.mean()
    return w, b


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """One row for each row of df: id, host, path, rule, verdict, score (the model's probability that the URL is unwanted).

    verdict is the longest fitting rule's, else block if score >= 0.5, else allow. A null URL or one without :// has an
    empty host and path, which the model judges like any other. Ids may be null or repeat. Other columns are ignored.
    """
    w, b = train(labelled if labelled is not None else labelled_urls())
    w, b = w.astype(np.float64), float(b)
    kind = df.schema[id_col].dataType
    url = free_name(df, "url_")
    host, path = split_url(F.col(url))
    found = rule_of(F.col("host"), F.col("path"), rules)
    cols = df.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias(url)).select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", found.alias("found"))
    cols = cols.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            score = [1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(1, len(g))) + b))) for g in map(grams, p["host"], p["path"])]
            p["score"] = np.array(score, float)
            p["verdict"] = p["ruled"].where(p["ruled"].notna(), np.where(p["score"] >= 0.5, "block", "allow"))
            yield p[["page_id", "host", "path", "rule", "verdict", "score"]]

    return cols.mapInPandas(run, "page_id string, host string, path string, rule string, verdict string, score double").withColumn("page_id", F.col("page_id").cast(kind))
