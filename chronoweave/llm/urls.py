"""URL filter: prefix rules first, then gradient-boosted trees on lexical features.

Rules are (action, host/path prefix); a rule fits its host and all subdomains where the url's path
starts with the rule's path, and the longest fitting rule decides. Where no rule fits, boosted trees
decide. They are trained from labelled urls: the rows on which a rule decides, a bounded sample of
``sample`` rows (the smallest hashes of url and id, so the same on every run; tasks offer only rows under a hash
that about ``sample`` rows lie under). Features: lengths, depth, digit ratio, character entropy, parameter counts, and
smoothed statistics of the suffixes of the host and of the first path segment. A url's statistics are those of
the sample's other folds where the trees are trained, and those of the whole sample where urls are judged.

Cases: a null url or one without ``://`` has an empty host and path and fits no rule; repeated rows
each give a row; without labelled rows everything that no rule blocks is allowed; an empty table
gives no rows; columns other than the id and the url are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, id_types

RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SAMPLE = 10_000
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "entropy",
            "host_entropy", "parameters", "hyphens", "suffix1", "suffix2", "segment")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and the rest of a url."""
    rest = (url or "").partition("://")[2]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[cut:]
    end = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return rest[:cut], tail[:end], tail[end:]


def keys(url: str | None) -> tuple[str, str, str]:
    host, path, _ = split_url(url)
    labels = host.lower().split(".")
    return labels[-1], ".".join(labels[-2:]), path.split("/")[1] if path.count("/") else ""


@dataclass
class Statistics:
    """Smoothed block rates of suffixes and segments in the training sample."""

    rates: list[dict[str, float]] = field(default_factory=list)
    base: float = 0.5

    @classmethod
    def of(cls, urls: list[str | None], labels: np.ndarray) -> Statistics:
        base = float(labels.mean()) if len(labels) else 0.5
        tallies = [{}, {}, {}]
        for url, y in zip(urls, labels):
            for tally, key in zip(tallies, keys(url)):
                n, s = tally.get(key, (0, 0.0))
                tally[key] = (n + 1, s + y)
        return cls([{k: (s + 5 * base) / (n + 5) for k, (n, s) in t.items() if n >= 5} for t in tallies], base)


def training_features(urls: list[str | None], labels: np.ndarray) -> np.ndarray:
    """The features of labelled urls, each with the statistics of the other folds."""
    rows = np.zeros((len(urls), len(FEATURES)))
    for k in range(FOLDS):
        others = [i for i in range(len(urls)) if i % FOLDS != k]
        rows[k::FOLDS] = features(urls[k::FOLDS], Statistics.of([urls[i] for i in others], labels[others]))
    return rows


def fit(urls: list[str | None], labels: np.ndarray) -> tuple[Statistics, Trees]:
    return Statistics.of(urls, labels), boost(training_features(urls, labels), labels)


def features(urls: list[str | None], stats: Statistics) -> np.ndarray:
    rows = np.zeros((len(urls), len(FEATURES)))
    for r, url in zip(rows, urls):
        host, path, rest = split_url(url)
        url = url or ""
        digits = sum(c.isdigit() for c in url)
        r[:11] = (
            len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits / max(1, len(url)),
            sum(c.isdigit() for c in host) / max(1, len(host)), entropy(url), entropy(host), rest.count("="), host.count("-"),
        )
        r[11:] = [rates.get(k, stats.base) for rates, k in zip(stats.rates, keys(url))] if stats.rates else stats.base
    return rows


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss; nodes in arrays, leaves have feature -1."""

    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, split, value in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(feature[at], 0)] > split[at])
                at = np.where(inner, go, at)
            total += value[at]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10) -> Trees:
    if not len(y) or y.min() == y.max():
        return Trees(-10.0 if not len(y) or y.max() == 0 else 10.0, [])
    p = y.mean()
    start = float(math.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, prob * (1 - prob)
        size = 2 ** (depth + 1) - 1
        feature, split, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(len(y), int)
        for node in range(size):
            mine = at == node
            g, h = grad[mine].sum(), hess[mine].sum()
            value[node] = rate * g / (h + 1.0)
            if node >= size // 2 or mine.sum() < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                b = binned[mine, f]
                n = len(cuts[f]) + 1
                gl, hl, cl = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (grad[mine], hess[mine], None))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(cl < least) | (mine.sum() - cl < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                feature[node], split[node] = best[1], cuts[best[1]][best[2]]
                at[mine] = 2 * node + 1 + (binned[mine, best[1]] > best[2])
        total += value[at]
        trees.append((feature, split, value))
    return Trees(start, trees)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action. The rules stand in the plan, so they should be few."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, prefix in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = prefix.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, action = F.when(fits, prefix).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the trees; null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    labelled = rows.where("action is not null").select("url", "action", F.xxhash64("url", "page_id").alias("h"))
    n = labelled.count()
    if n > sample:
        # Hashes are even, so a share of their range has about that share of the rows: with a margin of six
        # standard deviations, tasks offer little more than the sample, together and at every size.
        share = (sample + 6 * math.sqrt(sample)) / n
        labelled = labelled.where(F.col("h") < int(min(2**63 - 1, -(2**63) + 2**64 * share)))
    taken = labelled.orderBy("h", "url", "action").limit(sample).collect()
    stats, trees = fit([r["url"] for r in taken], np.array([float(r["action"] == "block") for r in taken]))
    arrow_id, sql_id = id_types(pages, "page_id")
    schema = pa.schema([("page_id", arrow_id), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])

    def score(batches):
        for b in batches:
            actions, urls = b.column("action").to_pylist(), b.column("url").to_pylist()
            p = iter(trees.score(features([u for u, a in zip(urls, actions) if a is None], stats)).tolist())
            scores = [next(p) if a is None else None for a in actions]
            yield batch(
                schema, page_id=b.column("page_id"), host=b.column("host"), path=b.column("path"), rule=b.column("rule"),
                verdict=[a or ("block" if x >= 0.5 else "allow") for a, x in zip(actions, scores)], score=scores,
            )

    return rows.mapInArrow(score, f"page_id {sql_id}, host string, path string, rule string, verdict string, score double")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
