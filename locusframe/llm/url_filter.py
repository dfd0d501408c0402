"""URL verdicts: exact rules first, then a naive Bayes score of segmented words.

Host names and paths are cut at all characters but letters; a unigram Viterbi pass splits
what is left into known words, because names are often written together. A multinomial naive
Bayes classifier then scores the words. Words that it does not know count for neither side.
"""

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Labelled examples: one name of a site per entry, its words joined by hyphens.
BLOCKED = (
    "casino casino-win casino-bonus online-casino poker poker-bonus free-bets bets bet-win betting "
    "slots jackpot lottery gambling cheap-pills pills viagra cialis pharmacy-cheap adult adult-x "
    "adult-video xxx sex sex-cam porn porn-tube nude escort dating-adult spam spam-farm link-farm "
    "ads ads-track ad-track tracker tracking click-bait popup-ads affiliate-spam malware phishing "
    "crack warez torrent keygen free-money payday-loan loan-fast get-rich replica-cheap"
).split()
ALLOWED = (
    "news world-news tech-blog wiki docs library science history school university museum "
    "weather health research open-data city-guide travel recipes garden music film book-review "
    "magazine journal forum community support project software code academy sports culture art "
    "radio politics economy law medical-journal nature space physics math language law-review "
    "open-software open-library open-source family-farm farm-news city-news track-and-field"
).split()

# First labels of a host that tell how it is served, not what it is about.
SERVICE = re.compile(r"^(?:(?:www\d?|m|mobile|blog|cdn|static)\.)+")

# Costs of the segmentation in nats: a known word costs the negative logarithm of its share; an
# unknown piece costs more than any known word, and more the longer it is.
UNKNOWN, UNKNOWN_LETTER = 8.0, 1.2
BLOCK_ABOVE = 0.0

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct `(rule, verdict)`, or NULL.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of equally
    long ones the later in the alphabet wins.
    """
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    out = None
    for verdict, name, start in ordered:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


class Model:
    """Word counts of both classes, the segmentation and the score."""

    def __init__(self, blocked: list[str], allowed: list[str]):
        self.counts = [Counter(w for name in names for w in name.split("-")) for names in (blocked, allowed)]
        self.words = self.counts[0] + self.counts[1]
        self.total = sum(self.words.values())
        self.longest = max(map(len, self.words), default=1)
        n, m = (sum(c.values()) + len(self.words) for c in self.counts)
        self.odds = {
            w: math.log((self.counts[0][w] + 1) / n) - math.log((self.counts[1][w] + 1) / m) for w in self.words
        }
        self.split = lru_cache(maxsize=100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        """The cheapest words of a run of letters; known ones and unknown pieces between."""
        cost, back = [0.0], [0]
        gap_cost, gap_start = [math.inf], [0]  # cheapest ending inside an unknown piece
        for end in range(1, len(name) + 1):
            begin, go_on = cost[end - 1] + UNKNOWN + UNKNOWN_LETTER, gap_cost[end - 1] + UNKNOWN_LETTER
            gap_cost.append(min(begin, go_on))
            gap_start.append(end - 1 if begin < go_on else gap_start[end - 1])
            best, origin = gap_cost[end], gap_start[end]
            for start in range(max(0, end - self.longest), end):
                count = self.words.get(name[start:end])
                if count:
                    now = cost[start] - math.log(count / self.total)
                    if now < best:
                        best, origin = now, start
            cost.append(best)
            back.append(origin)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(words))

    def segments(self, host: str, path: str) -> list[str]:
        runs = re.findall(r"[a-z]+", SERVICE.sub("", host)) + re.findall(r"[a-z]+", path.lower())
        return [word for run in runs for word in self.split(run)]

    def score(self, words: list[str]) -> float:
        return sum(self.odds.get(word, 0.0) for word in words)


def judge(
    pages: DataFrame,
    rules: list[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    blocked: list[str] = BLOCKED,
    allowed: list[str] = ALLOWED,
) -> DataFrame:
    """One row `(id, host, path, rule, verdict, score, words)` per page.

    Without a fitting rule a page is blocked if its score is above zero. A NULL url, or one
    without `://`, has an empty host and path and is allowed. Rows are judged one by one.
    """
    kind = dict(pages.dtypes)[id_column]

    def run(batches):
        model = Model(blocked, allowed)
        for batch in batches:
            words = [
                model.segments(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            scores = pa.array([model.score(w) for w in words], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, scores, pa.array(words, pa.list_(pa.string()))],
                names=[*batch.schema.names, "score", "words"],
            )

    url = F.col(url_column)
    rows = bounded_batches(pages).select(
        F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    scored = rows.mapInArrow(run, f"id {kind}, host string, path string, score double, words array<string>")
    found = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") > BLOCK_ABOVE, "block").otherwise("allow")
    return scored.withColumn("found", found).select(
        "id",
        "host",
        "path",
        F.col("found")["rule"].alias("rule"),
        F.coalesce(F.col("found")["verdict"], own).alias("verdict"),
        "score",
        "words",
    )
