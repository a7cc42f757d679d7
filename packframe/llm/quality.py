"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

The statistics come from whole texts. Two plain rules fail a document outright (under 50 words; more than half of the words in
repeated three-word windows). The others are judged by boosted trees that are fitted on labelled documents (quality 0 or 1): logistic loss,
histograms of 64 bins, depth 3. Features listed in MONOTONE can only lower the score as they rise: a split that breaks this is refused, and
the children of a split are held to its midpoint. The trees are flattened to numpy node arrays, and a batch walks all of them level by level.

The fit reads at most ``sample`` labelled documents (those with the smallest hashes), the bound on the driver's work;
every document is scored.

Edge cases: a null or empty text has zero in every count and fails; without labels of both classes only the rules decide; repeated rows are judged each;
several labels of a document count each; an empty table gives an empty result; clashing columns in labels are not read (only doc_id and quality).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "bang_ratio", "line_words", "stop_ratio", "long_ratio")
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "bang_ratio": -1}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
UPPERS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside three-word windows that occur twice or more, and the number of distinct words."""
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(x) < 3 or len(ids) == len(x):
        return 0, len(ids)
    _, pair = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)
    _, which, n = np.unique(pair[:-1] * len(ids) + x[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    inside = np.zeros(len(x), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum()), len(ids)


def text_stats(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on exactly the six ASCII spaces
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat, kinds = repeated_words(words)
    size = max(len(raw), 1)
    some = max(n, 1)
    return n, chars, symbols, dup, repeat, [
        float(n), chars / some, symbols / some, dup / max(len(lines), 1), repeat / some, kinds / some,
        (len(raw) - len(raw.translate(None, UPPERS))) / size, (len(raw) - len(raw.translate(None, DIGITS))) / size, raw.count(b"!") / some, n / max(len(lines), 1),
        sum(len(w) <= 3 for w in words) / some, sum(len(w) > 20 for w in words) / some,
    ]


def stats_of(text: str) -> Column:
    @F.pandas_udf(STATS)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=[x.split()[0] for x in STATS.split(", ")])

    return stats(text)


class BoostedTrees:
    """Nodes of all trees in flat arrays; a leaf points to itself."""

    def __init__(self, feature, threshold, left, right, value, roots, base, depth):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.base, self.depth = roots, base, depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> BoostedTrees:
    """Second-order boosting on histograms; signs: -1, 0 or 1 for each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(len(x), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(value)
        feature.append(0), threshold.append(0.0), left.append(i), right.append(i), value.append(0.0)
        return i

    def grow(i, rows, g, h, lo, hi, level) -> None:
        sg, sh = g[rows].sum(), h[rows].sum()
        here = float(np.clip(-sg / (sh + ridge), lo, hi))
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(edges[f]) + 1))[:-1]
            a, b = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(sg - gl) / (sh - hl + ridge), lo, hi)
            gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
            ok = (nl >= least) & (len(rows) - nl >= least) & (signs[f] * (b - a) >= 0)
            if ok.any() and (top := np.where(ok, gain, -1).argmax()) is not None and gain[top] > best[0]:
                best = (gain[top], (f, int(top), float(a[top]), float(b[top])))
        if best[1] is None:
            value[i] = here * rate
            score[rows] += value[i]
            return
        f, cut, a, b = best[1]
        mid = (a + b) / 2
        feature[i], threshold[i] = f, float(edges[f][cut])
        left[i], right[i] = node(), node()
        goes = binned[rows, f] <= cut
        lo_hi = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[int(signs[f])]
        grow(left[i], rows[goes], g, h, *lo_hi[0], level + 1)
        grow(right[i], rows[~goes], g, h, *lo_hi[1], level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(node())
        grow(roots[-1], np.arange(len(x)), p - y, p * (1 - p), -np.inf, np.inf, 0)
    arrays = (np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots))
    return BoostedTrees(*arrays, base, depth)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> BoostedTrees | None:
    """Trees from at most sample labelled documents; None if a class is missing."""
    chosen = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "quality").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = own.select("h", "doc_id", "quality", stats_of("text")["features"].alias("x")).collect()  # at most sample rows of a dozen numbers
    rows.sort(key=lambda r: (r.h, r.doc_id, r.quality, r.x))
    y = np.array([r.quality for r in rows], float)
    if len(set(y)) < 2:
        return None
    return fit_trees(np.array([r.x for r in rows]), y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def _scored(docs: DataFrame, labels: DataFrame, threshold: float, sample: int):
    """The judgement of a text as a column: the counts, base_failed, score (probability of good quality) and kept."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels, sample))  # at most 60 trees of 15 nodes

    # one function for counts and score, so that a task needs one Python worker
    @F.pandas_udf(STATS + ", score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([text_stats(t) for t in texts], columns=[x.split()[0] for x in STATS.split(", ")])
        out["score"] = 1.0 if shared.value is None or not len(out) else 1 / (1 + np.exp(-shared.value.margin(np.stack(out["features"].to_numpy()))))
        return out

    def verdict(q: Column) -> Column:
        failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
        counts = [q[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*counts, failed.alias("base_failed"), q["score"].alias("score"), (~failed & (q["score"] >= threshold)).alias("kept"))

    return scored, verdict


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """Two structs for each row of docs: d, its columns, and q, its judgement."""
    scored, verdict = _scored(docs, labels, threshold, sample)
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), scored("text").alias("q"))
    return x.select("d", verdict(F.col("q")).alias("q"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("d.doc_id", "q.*")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that are judged bad; same columns, whatever their names."""
    return judge(docs, labels, **options).filter("q.kept").select(*[F.col("d")[c].alias(c) for c in docs.columns])
