"""URL filtering by a character language-model ratio, behind host and path rules.

Rules decide the urls they fit (longest rule first). Urls that no rule fits are judged by two variable-order Markov models over characters,
one of accepted and one of rejected urls: each order's counts are interpolated with the next lower order by Witten-Bell smoothing, down to a uniform
law over the alphabet. The score is the difference of the log-likelihoods divided by the length; a url is blocked below a threshold
that is calibrated on labelled urls which were held out of the counts, so that the two error rates are as equal as can be.

The labels are the rules' own verdicts, unless the caller gives labels. The models are fitted on at most ``sample`` labelled urls of each class (those with the
smallest hashes), a bound on the driver's work and on the broadcast tables whatever the input size; every url is scored.

Edge cases: null urls and those without ``://`` have an empty host and path, fit no rule and are judged by the model like any other (null as empty, which scores 0, so it is blocked where the cut is above 0);
without labels of both classes every url scores 0 and is allowed; repeated rows are judged each; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import ascii_lower, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 4
ALPHABET = 128


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _codes(urls) -> tuple[np.ndarray, np.ndarray]:
    """All urls as one array of symbols, each after ORDER start symbols (0), and the lengths without those."""
    raw = [("" if u is None or u is pd.NA else u).encode("utf-8", "replace") for u in urls]
    flat = np.frombuffer(b"".join(b"\0" * ORDER + r for r in raw), np.uint8).astype(np.int64)
    return np.minimum(flat, ALPHABET - 1), np.array([len(r) for r in raw], np.int64)


def _contexts(codes: np.ndarray, lengths: np.ndarray):
    """For order k = 0..ORDER the key of each predicted position's context, exact: the last k symbols in base ALPHABET; and the symbols."""
    total = lengths + ORDER
    start = np.cumsum(total) - total
    inside = np.ones(len(codes), bool)
    for k in range(ORDER):
        inside[start + k] = False
    at = np.flatnonzero(inside)
    key, out = np.zeros(len(at), np.int64), []
    for k in range(ORDER + 1):
        if k:
            key = key + codes[at - k] * ALPHABET ** (k - 1)
        out.append(key)
    return out, codes[at]


class MarkovModel:
    """For each order, sorted contexts with their counts and numbers of distinct symbols, and sorted contexts with a symbol and theirs. The tables hold what was seen
    in training only, so the number of training urls bounds them.

    p(symbol | context) = (count of both + kinds * p(symbol | shorter context)) / (count of the context + kinds), down to 1 / ALPHABET; the
    probabilities of a context add up to 1, and none is 0."""

    def __init__(self, urls):
        contexts, symbols = _contexts(*_codes(urls))
        self.tables = []
        for key in contexts:
            both, n_both = np.unique(key * ALPHABET + symbols, return_counts=True)
            names, first, kinds = np.unique(both // ALPHABET, return_index=True, return_counts=True)
            self.tables.append((names, np.add.reduceat(n_both, first) if len(first) else n_both, kinds, both, n_both))

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
        """values[i] where table[i] is the key, else 0."""
        if not len(table):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return np.where(table[at] == key, values[at], 0)

    def prob(self, contexts: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        p = np.full(len(symbols), 1.0 / ALPHABET)
        for key, (names, n_names, kinds, both, n_both) in zip(contexts, self.tables, strict=True):
            n, t = self._find(names, n_names, key), self._find(names, kinds, key)
            p = np.where(n > 0, (self._find(both, n_both, key * ALPHABET + symbols) + t * p) / np.maximum(n + t, 1), p)
        return p


def score(models: tuple[MarkovModel, MarkovModel] | None, urls) -> np.ndarray:
    """(log-likelihood as accepted - as rejected) / length for each url; 0 for an empty one."""
    codes, lengths = _codes(urls)
    if models is None or not len(lengths):
        return np.zeros(len(lengths))
    contexts, symbols = _contexts(codes, lengths)
    diff = np.log(models[0].prob(contexts, symbols)) - np.log(models[1].prob(contexts, symbols))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(owner, diff, len(lengths)) / np.maximum(lengths, 1)


def calibrate(yes: np.ndarray, no: np.ndarray) -> tuple[float, float, float]:
    """(cut, share of accepted urls below it, share of rejected ones at it or above): the cut at which the two are as equal as can be, from sorted scores."""
    cuts = np.unique(np.concatenate([yes, no]))
    lost = np.searchsorted(yes, cuts, "left") / len(yes)
    let = 1 - np.searchsorted(no, cuts, "left") / len(no)
    best = np.lexsort((lost + let, np.abs(lost - let)))[0]
    below = no[no < cuts[best]].max(initial=-np.inf)
    # the middle of the gap where the classes are apart: then no rejected url is at the cut or above it, and no accepted one below it
    apart = np.isfinite(below) and lost[best] == let[best] == 0
    return float((below + cuts[best]) / 2 if apart else cuts[best]), float(lost[best]), float(let[best])


def fit(labelled: DataFrame, sample: int = 20_000):
    """labelled (url, good) -> models, threshold, and the two error rates on held-out urls; (None, 0.0, 0.0, 0.0) if a class is missing. A fifth of the sample is kept for
    the threshold. A label's url counts once, however often it comes."""
    got = []
    for good in (True, False):
        rows = labelled.filter(F.col("good") == good).select("url").distinct().select("url", F.xxhash64("url").alias("h")).orderBy("h", "url").limit(sample).collect()
        got.append(([r.url for r in rows if r.h % 5], [r.url for r in rows if r.h % 5 == 0]))
    if not all(train for train, _ in got):
        return None, 0.0, 0.0, 0.0
    models = tuple(MarkovModel(train) for train, _ in got)
    return models, *calibrate(*(np.sort(score(models, held or train)) for train, held in got))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = 20_000) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, score."""
    spark = pages.sparkSession
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    x = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", rule).withColumn("said", said)
    known = labelled if labelled is not None else x.filter(F.col("said").isNotNull()).select("url", (F.col("said") == "allow").alias("good"))
    models, threshold, _, _ = fit(known, sample)
    shared = spark.sparkContext.broadcast(models)  # tables of 2 * sample urls

    @F.pandas_udf("double")
    def scored(urls: pd.Series) -> pd.Series:
        return pd.Series(score(shared.value, urls))

    x = x.withColumn("score", scored(F.coalesce("url", F.lit(""))))
    return x.withColumn("verdict", F.coalesce("said", F.when(F.col("score") < threshold, "block").otherwise("allow")))


def op5_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
