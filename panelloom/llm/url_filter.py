"""URL filters: allow and block rules, and for the rest a logistic regression on hashed character n-grams.

The model is trained in numpy from the small labelled table of ``url_labels``, which holds no URL or host of
the tables it judges; n-grams of host and path are hashed with different salts. Host and path are cut out by Spark expressions; only scoring passes through Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import LOWER, prefix_hash, span_hash, table, text_slices
from panelloom.llm.url_labels import LABELLED

BUCKETS = 1 << 16
#: What the mean over a path's n-grams counts beside the host's; chosen on held-out hosts of the labelled table.
PATH_SHARE = 0.25
FOLDED = LOWER.copy()
FOLDED[48:58] = 48
GRAMS = (3, 4, 5)
#: Rules of the registered query: (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` up to ``/ ? #``; path from there up to ``? #``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, for a short list of rules."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, p = _split(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules (verdict, rule) of any size: ``urls`` has key, host, path.

    Each host meets the rules of its own suffixes by an equi-join; the longest fitting rule wins. A rule
    that is listed with both verdicts blocks; null rules fit nothing.
    """
    cut = rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    cut = cut.select("verdict", "rule", F.lower(F.substring_index("rule", "/", 1)).alias("suffix"), F.when(F.instr("rule", "/") > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("start"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return urls.select("key", "path", F.explode(suffixes).alias("suffix")).join(cut, "suffix").where(F.col("path").startswith(F.col("start"))).groupBy("key").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("ruled"))


def gram_rows(data: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each row, and the rows; all digits are one character, letters' case is ignored."""
    prefix = prefix_hash(FOLDED[data].astype(np.uint64) + np.uint64(1))
    hashes, rows = [], []
    for n in GRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[row + 1]
        hashes.append(span_hash(prefix, at[inside], at[inside] + n))
        rows.append(row[inside])
    h = np.concatenate(hashes) ^ np.uint64(salt)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64), np.concatenate(rows)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probability of block; mean weight of host n-grams and of path n-grams, so length doesn't count."""
        n = len(hosts[1]) - 1
        z = np.full(n, self.bias)
        for salt, share, (data, offsets) in ((1, 1.0, hosts), (2, PATH_SHARE, paths)):
            bucket, row = gram_rows(data, offsets, salt)
            z += share * np.bincount(row, self.weights[bucket], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def _plain_split(url: str) -> tuple[str, str]:
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def train(labelled: list[tuple[str, int]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-3) -> UrlModel:
    """Gradient descent on the logistic loss with an L2 penalty; both labels weigh alike, however many rows have them.

    No rows give an even model.
    """
    model = UrlModel(np.zeros(BUCKETS), 0.0)
    if not labelled:
        return model
    parts = [_plain_split(u) for u, _ in labelled]
    y = np.array([k for _, k in labelled], float)
    weigh = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    grams = []
    for salt, share, texts in ((1, 1.0, [p[0] for p in parts]), (2, PATH_SHARE, [p[1] for p in parts])):
        bucket, row = gram_rows(*_packed(texts), salt)
        grams.append((bucket, row, (share / np.maximum(1, np.bincount(row, minlength=len(y))))[row]))
    bucket, row, value = (np.concatenate(x) for x in zip(*grams, strict=True))
    for _ in range(rounds):
        z = model.bias + np.bincount(row, model.weights[bucket] * value, minlength=len(y))
        g = (1 / (1 + np.exp(-z)) - y) * weigh
        model.weights -= rate * (np.bincount(bucket, g[row] * value, minlength=BUCKETS) + decay * model.weights)
        model.bias -= rate * 0.1 * g.mean()
    return model


def judged(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages`` (page_id, url, ...).

    A url that is null or has no ``://`` has empty host and path and is judged by the model on those;
    repeated rows are judged each; an empty table gives no rows.
    """
    model = spark.sparkContext.broadcast(train(labelled))  # BUCKETS weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = ([(d, o) for _, d, o in text_slices(batch, c)] for c in ("host", "path"))
            if len(hosts) > 1 or len(paths) > 1:
                hosts, paths = ([_packed(batch.column(c).to_pylist())] for c in ("host", "path"))
            score = model.value.scores(hosts[0], paths[0]) if hosts and batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(score)], names=[*batch.schema.names, "score"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", rule_column(rules, F.col("host"), F.col("path"))).select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.col("ruled.verdict").alias("ruled"))
    out = rows.mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the four rules and the model."""
    return judged(spark, table(spark, sf_dir, "pages"), RULES)
