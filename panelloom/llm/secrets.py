"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. A ledger remembers which
(blob, rule version) pairs have been scanned and what was found; a run scans only pairs it has not seen,
one copy of each blob, and joins findings back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import stored, table

#: Base kinds, in their order, with the least length of what must be long.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Further kinds: pattern and a string that must occur.
MORE = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"), "PRIVATE KEY-----"),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "eyJ"),
    ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
    ("cloud", re.compile(r"AIza[A-Za-z0-9_-]{35}"), "AIza"),
]
KINDS = [*BASE, *(k for k, _, _ in MORE)]
RULE_VERSION = "1:" + hashlib.sha256("\n".join([ASSIGN.pattern, ACCESS.pattern, HEX.pattern, *(p.pattern for _, p, _ in MORE)]).encode()).hexdigest()[:16]


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in order, in code points; matches that are too short are dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for i, (_, pattern, must) in enumerate(MORE, len(BASE)):
        if must in text:
            found += [(m.start(), i, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"blob": frame["blob"], "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in frame["text"]]})


LEDGER = "blob string, rule_version string, spans array<struct<kind: string, start: bigint, end: bigint>>"


def scan(spark: SparkSession, versions: DataFrame, key: str, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions`` (key, text, ...), and the ledger's new rows.

    The first result has (key, blob, spans) for each row, also those without findings. Null texts are
    the empty blob; rows without key take part; repeated rows are answered each. The second has LEDGER's
    columns for blobs that this run scanned: append it to the ledger that the next run is given.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = versions.select(F.col(key).cast("long").alias("key"), text.alias("text"))
    # rows without key are spread by their content
    rows = rows.withColumn("at", F.coalesce("key", F.xxhash64("text")))
    paths = stored(spark, rows.select("key", "at", F.sha2(F.col("text").cast("binary"), 256).alias("blob")), "paths")
    one = paths.groupBy("blob").agg(F.min("at").alias("at"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version)
        one = one.join(seen.select("blob"), "blob", "left_anti")
    # one copy of each unseen blob; the join on the place alone leaves nothing hot, the content is compared after it
    chosen = rows.join(one.hint("shuffle_merge"), "at").where(F.sha2(F.col("text").cast("binary"), 256) == F.col("blob")).select("blob", "text")
    fresh = stored(spark, chosen.mapInPandas(_scan, "blob string, spans array<struct<kind: string, start: bigint, end: bigint>>").dropDuplicates(["blob"]), "findings")
    known = fresh if ledger is None else fresh.unionByName(seen.select("blob", "spans").dropDuplicates(["blob"]))
    return paths.join(known, "blob", "left").select("key", "blob", "spans"), fresh.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


class BlobLedger:
    """A ledger kept as a Parquet table in a shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, key: str) -> DataFrame:
        """Scan what the ledger has not seen, append it, and return (key, blob, spans) of all rows."""
        found, fresh = scan(self.spark, versions, key, self.rows())
        found = stored(self.spark, found, "found")
        fresh.write.mode("append").parquet(self.path)
        return found


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with an empty ledger."""
    found, _ = scan(spark, table(spark, sf_dir, "documents"), "doc_id")
    base = f"filter(spans, s -> s.kind in ({', '.join(map(repr, BASE))}))"
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select(F.col("key").alias("doc_id"), *map(count, BASE), F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _sql_matches(number: int, pattern: str, long: str = "true") -> str:
    """SQL list of (a, k, b) of the matches of a kind in ``t``: places are summed up from the texts around the matches."""
    quoted = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{quoted}')) + 1), lambda i: {{
    'a': list_sum(list_transform(string_split_regex(t, '{quoted}')[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, '{quoted}')[1:i - 1], lambda x: length(x))), 0)::BIGINT,
    'k': {number}, 'n': length(regexp_extract_all(t, '{quoted}')[i]), 'g': length(regexp_extract_all(t, '{quoted}', {2 if number == 0 else 0})[i])}}), lambda m: {long})"""


_SQL_ASSIGN = ASSIGN.pattern.replace("password|passwd|secret|token|api_?key", "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")))
_SQL_LISTS = ", ".join([_sql_matches(0, _SQL_ASSIGN, "m.g >= 8"), _sql_matches(1, ACCESS.pattern, "m.n >= 16"), _sql_matches(2, HEX.pattern), *(_sql_matches(k, p.pattern.replace(r"\Z", r"\z")) for k, (_, p, _) in enumerate(MORE, len(BASE)))])
_SQL_SPAN = f"lambda m: [{', '.join(map(repr, KINDS))}][m.k + 1] || ':' || m.a || ':' || (m.a + m.n)"

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(flatten([{_SQL_LISTS}])) AS s FROM d)
SELECT doc_id, {', '.join(f"len(list_filter(s, lambda m: m.k = {k}))::BIGINT AS n_{kind}" for k, kind in enumerate(BASE))},
  sha256(coalesce(array_to_string(list_transform(list_filter(s, lambda m: m.k < {len(BASE)}), {_SQL_SPAN}), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(s, {_SQL_SPAN}), ','), '') AS spans
FROM f
"""
