"""URL filters: rules on host and path, then a learned score (operator 4).

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path goes on up to ``?``, ``#`` or the end. A rule fits its host and all
subdomains when the path starts with the rule's; of several the longest (host and path
together; blocking first among equals) decides.

Other urls are judged by logistic regression on hashed character n-grams of host and path,
fitted to a small labelled table: rows (url, blocked), at most TABLE_ROWS of them, chosen by
hash if there are more. Host and path have n-grams of their own, framed by ^ and $. The bias is the
log-odds of the table's own share of blocked urls, which is what a url without known n-grams is judged by.

Cases: a null url, or one without ``://``, has empty host and path; no rule fits those and
the model's bias judges them; long urls are read whole; repeated rows are judged each; an
empty page table gives an empty result, and an empty labelled table allows what no rule
blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches

ALLOW, BLOCK = "allow", "block"
NGRAMS = (3, 4, 5)
SLOTS = 1 << 16
#: Rows of the labelled table that are used; steps, rate and L2 penalty of the fit.
TABLE_ROWS = 20_000
STEPS, RATE, PENALTY = 2000, 6.0, 1e-4
class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# What sites are about, by words that name them, and neutral words that stand beside those. Chosen from
# general knowledge of the web, without a look at any table that is to be judged.
BLOCKED_WORDS = (
    "casino poker roulette slots jackpot betting bets gamble bingo lottery viagra cialis pills pharmacy-online steroid xanax "
    "porn xxx sexcam escort hentai nude adult camgirl warez torrent crack keygen serial pirated phishing malware trojan ransom "
    "spam popup adserver clickbait tracker doubleclick banner affiliate payday loan forex bitcoin crypto ponzi "
    "replica counterfeit fakewatch miracle weightloss giveaway prize freemoney hack cheat linkfarm clickfarm"
).split()
ALLOWED_WORDS = (
    "library museum university college school academy research science physics chemistry biology medicine hospital clinic nursing "
    "news times herald journal gazette magazine radio television weather climate ocean river mountain forest garden botany "
    "history archive heritage culture theatre opera orchestra music guitar piano painting gallery poetry novel book reading "
    "writing dictionary encyclopedia grammar language translation teaching learning kids parents family health food recipe cooking "
    "kitchen bakery coffee travel hiking cycling running football tennis swimming chess railway airport harbour city town village council "
    "government parliament court police election charity foundation church community software compiler database python linux "
    "engineering robotics space astronomy camera photo design furniture carpentry knitting fashion shoes bank insurance energy solar "
    "farm animals birds dogs cats veterinary fishing sailing weatherproof literacy therapist antispam trackandfield analysis classics"
).split()
NEUTRAL_WORDS = "online world best my the great net zone hub daily central house point first star land club direct home today".split()
DOMAINS = "com org net info de fr es co.uk io eu".split()
PATHS = ("/", "/en/12", "/fr/305.html", "/de/7/", "/es/88", "/index.html", "/a/b?c=1")
#: Sites made of each word.
SITES_PER_WORD = 6


def site_names(word: str, n: int) -> list[str]:
    """``n`` sites named after a word, by rule: the word alone, before or after neutral ones, with a host prefix."""
    out = []
    for i in range(n):
        k = zlib.crc32(f"{word}:{i}".encode())
        beside = NEUTRAL_WORDS[k % len(NEUTRAL_WORDS)]
        name = (word, word + beside, beside + word, f"{word}-{beside}", f"{beside}-{word}", f"{word}{k % 90 + 10}")[i % 6]
        out.append(("", "www.", "", "blog.", "m.")[k // 97 % 5] + f"{name}.{DOMAINS[k // 1009 % len(DOMAINS)]}")
    return out


def labelled_rows() -> list[tuple[str, bool]]:
    """The small labelled table: url, blocked."""
    return [(f"https://{site}{PATHS[zlib.crc32(site.encode()) % len(PATHS)]}", blocked)
            for words, blocked in ((BLOCKED_WORDS, True), (ALLOWED_WORDS, False)) for word in words for site in site_names(word, SITES_PER_WORD)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, blocked boolean")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit("")))


def rule_column(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """``field`` of the rule that decides, null if none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == BLOCK)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def slots(host: str, path: str) -> np.ndarray:
    """Hash slots of the n-grams of host and path."""
    grams = [f"{kind}{framed[i:i + n]}" for kind, framed in (("h", f"^{host}$"), ("p", f"^{path}$"))
             for n in NGRAMS for i in range(len(framed) - n + 1)]
    return np.unique(np.array([zlib.crc32(g.encode()) % SLOTS for g in grams], np.int64)) if grams else np.zeros(0, np.int64)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that the url is to be blocked."""
        at = slots(host, path)
        total = self.bias + (self.weights[at].sum() / np.sqrt(len(at)) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-total)))


def train(urls: DataFrame) -> Model:
    """Logistic regression on the labelled table, fitted by full-batch gradient steps."""
    host, path = host_and_path(F.col("url"))
    table = (urls.where("url is not null and blocked is not null")
             .select(host.alias("host"), path.alias("path"), F.col("blocked").cast("double").alias("y"))
             .orderBy(F.xxhash64("host", "path"), "y").limit(TABLE_ROWS).collect())  # bounded by TABLE_ROWS
    y = np.array([r.y for r in table])
    if not len(y) or y.min() == y.max():  # nothing to tell apart: all are like those of the table
        return Model(np.zeros(SLOTS), 1.0 if len(y) and y[0] else -1.0)
    used = [slots(r.host, r.path) for r in table]
    row = np.repeat(np.arange(len(used)), [len(u) for u in used])
    columns, at = np.unique(np.concatenate(used), return_inverse=True)
    value = 1 / np.sqrt(np.array([max(1, len(u)) for u in used]))[row]
    w, b = np.zeros(len(columns)), np.log(y.mean() / (1 - y.mean()))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at] * value, len(y)) + b)))
        error = (p - y) / len(y)
        w -= RATE * (np.bincount(at, error[row] * value, len(columns)) + PENALTY * w)
    weights = np.zeros(SLOTS)
    weights[columns] = w
    return Model(weights, float(b))


def judge(pages: DataFrame, rules: list[Rule], urls: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages``."""
    spark = pages.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(train(labelled_urls(spark) if urls is None else urls))  # SLOTS floats

    def column(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            yield pa.array([held.value.score(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())], pa.float64())

    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_column(h, p, rules, "verdict"), F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return (parts.withColumn("score", F.arrow_udf("double")(column)(h, p))
            .select("page_id", "host", "path", rule_column(h, p, rules, "text").alias("rule"), verdict.alias("verdict"), "score"))
