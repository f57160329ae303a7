"""Synthetic nearest neighbour imputation of a sparse matrix (row_id, col_id, value).

Missing pairs that share the rows observed in their column and the columns observed in their row share
their anchors: patterns are deduplicated and solved once. Rows with one pattern stand for each other, so
anchors are searched in the matrix of distinct patterns, grouped by the pattern of the missing column.

Where anchors are found, their regression is prepared: of an anchor set only its principal components on the
anchor columns and their weights on the wanted columns are left, whatever the number of its rows. Missing rows
meet that in a join, so that no anchor row is copied to them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.kernels import components_of, row_splits, search_biclique
from panelloom.sources.scratch import stored
from panelloom.spec import SnnConfig

#: ``exact``: whether the anchors behind the value are known to be the greatest.
FILLED = "row_id int, col_id int, value double, feasible boolean, exact boolean"
#: Row patterns that one task searches anchors for, about, and the span of row ids whose values are one row of a pattern's.
PATTERNS_A_TASK, ROWS_A_LIST = 256, 16_384


def row_sets(cells: DataFrame) -> DataFrame:
    """(row_id, obs_cols): sorted columns known in each row."""
    return cells.groupBy("row_id").agg(F.sort_array(F.collect_list("col_id")).alias("obs_cols"))


def column_sets(cells: DataFrame) -> DataFrame:
    """(col_id, obs_rows): sorted rows known in each column."""
    return cells.groupBy("col_id").agg(F.sort_array(F.collect_list("row_id")).alias("obs_rows"))


def missing_patterns(missing: DataFrame, cells: DataFrame) -> DataFrame:
    """Missing pairs with their pattern: (row_id, col_id, row_pattern, col_pattern)."""
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    rows = row_sets(cells).select("row_id", digest("obs_cols").alias("row_pattern"))
    cols = column_sets(cells).select("col_id", digest("obs_rows").alias("col_pattern"))
    return missing.join(rows, "row_id").join(cols, "col_id")


#: ``model``: an ``Anchors`` of the columns ``targets``, as bytes.
ANCHORS = "row_pattern string, col_pattern string, anchor_cols array<int>, targets array<int>, model binary, exact boolean"


def _dealt(d: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to all shuffle partitions: the work of a row is out of proportion to its bytes, by which they would be merged."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _anchor_finder(cfg: SnnConfig):
    def run(wanted: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """Anchors of the row patterns ``wanted`` in one column pattern, whose rows with their values are ``members``."""
        out, models = [], {}
        if len(wanted) and len(members):
            counts = members["rows"].map(len).to_numpy()
            rows = np.concatenate(members["rows"].to_numpy())
            known = np.unique(np.concatenate(members["obs_cols"].to_numpy()))
            x = np.full((len(rows), len(known)), np.nan)
            for n, end, own, vals in zip(counts, counts.cumsum(), members["obs_cols"], members["vals"], strict=True):
                x[end - n : end, np.searchsorted(known, own)] = np.asarray(vals).reshape(n, -1)
            order = np.argsort(rows)
            x, pattern = x[order], np.repeat(members["row_pattern"].to_numpy(), counts)[order]
            # rows are sorted, so that patterns come in the order of their first rows
            pattern, names = pd.factorize(pattern)
            first, copies = np.unique(pattern, return_index=True)[1], np.bincount(pattern)
            seen, targets = ~np.isnan(x[first]), np.asarray(wanted["targets"].iloc[0])
            for row_pattern, col_pattern, cols in zip(wanted["row_pattern"], wanted["col_pattern"], wanted["obs_cols"], strict=True):
                cols = np.intersect1d(cols, known, assume_unique=True)
                r, c, exact = search_biclique(seen[:, np.searchsorted(known, cols)], cfg.node_budget, copies)
                if len(r):
                    cols = cols[c]
                    key = (r.tobytes(), cols.tobytes())
                    if key not in models:
                        chosen = np.zeros(len(names), bool)
                        chosen[r] = True
                        own = x[chosen[pattern]]
                        if cfg.random_splits:
                            own = own[np.random.default_rng(cfg.seed).permutation(len(own))]
                        models[key] = Anchors.of(own[:, np.searchsorted(known, cols)], own[:, np.searchsorted(known, targets)], cfg).to_bytes()
                    out.append((row_pattern, col_pattern, cols, targets, models[key], exact))
        return pd.DataFrame(out, columns=["row_pattern", "col_pattern", "anchor_cols", "targets", "model", "exact"])

    return run


def find_anchors(patterns: DataFrame, cells: DataFrame, cfg: SnnConfig) -> DataFrame:
    """ANCHORS of each distinct pattern; empty anchors are left out."""
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    rows = row_lists(cells).withColumn("row_pattern", digest("cols"))
    # rows with one pattern have the same columns, and columns with one pattern the same rows
    values = F.sort_array(F.collect_list(F.struct("row_id", "vals")))
    row_pat = rows.groupBy("row_pattern", F.floor(F.col("row_id") / ROWS_A_LIST).alias("span")).agg(F.first("cols").alias("obs_cols"), values.alias("own"))
    row_pat = row_pat.select("row_pattern", "obs_cols", F.col("own.row_id").alias("rows"), F.flatten("own.vals").alias("vals")).persist()
    col_pat = column_sets(cells).select("col_id", digest("obs_rows").alias("col_pattern")).groupBy("col_pattern").agg(F.min("col_id").alias("col_id"), F.sort_array(F.collect_list("col_id")).alias("targets")).persist()
    wanted = patterns.select("row_pattern", "col_pattern").distinct()
    parts = wanted.groupBy("col_pattern").agg(F.ceil(F.count("*") / PATTERNS_A_TASK).cast("int").alias("parts"))
    wanted = wanted.join(parts, "col_pattern").withColumn("part", F.pmod(F.xxhash64("row_pattern"), F.col("parts")).cast("int"))
    wanted = wanted.join(col_pat.select("col_pattern", "targets"), "col_pattern").join(row_pat.groupBy("row_pattern").agg(F.first("obs_cols").alias("obs_cols")), "row_pattern")
    where = col_pat.select("col_pattern", "col_id").join(parts, "col_pattern")
    members = row_pat.withColumn("col_id", F.explode("obs_cols")).join(where, "col_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["col_pattern", "part"]
    wanted = _dealt(wanted.select(*keys, "row_pattern", "obs_cols", "targets"), *keys)
    names = [*keys, "row_pattern", "rows", "obs_cols", "vals"]
    members = _dealt(members.select(*names).toDF(*names), *keys)
    return wanted.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(_anchor_finder(cfg), ANCHORS)


def _ratio(residual: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Squared ratios of the norms of columns; NaN where there is nothing to compare with."""
    norm = (of * of).sum(axis=0)
    return np.where(norm > 0, (residual * residual).sum(axis=0) / np.where(norm > 0, norm, 1.0), np.nan)


class Anchors:
    """One anchor set's regression, for each split of its rows: (u, s) of its principal components on the anchor
    columns, their weights on the target columns, and the share of the targets that they don't span."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], cfg: SnnConfig) -> None:
        self.parts, self.cfg = parts, cfg

    @classmethod
    def of(cls, x1: np.ndarray, x2: np.ndarray, cfg: SnnConfig) -> Anchors:
        """x1: the values of the anchor rows on the anchor columns; x2: on the targets."""
        parts, m = [], x1.shape[1]
        for split in row_splits(np.arange(len(x1)), cfg.n_neighbors):
            a, b = x1[split], x2[split]
            if len(a) > m + b.shape[1]:
                # rows enter by their inner products alone: the triangle of a QR decomposition has the same
                r = np.linalg.qr(np.hstack((a, b)), mode="r")
                a, b = r[:, :m], r[:, m:]
            u, s, v = components_of(a.T, cfg.max_rank, cfg.spectral_t, cfg.min_singular_value, (m, len(split)))
            p = v @ b
            parts.append((u, s, p, _ratio(b - v.T @ p, b)))
        return cls(parts, cfg)

    def to_bytes(self) -> bytes:
        return b"".join(np.concatenate(([len(s)], *(x.ravel() for x in (u, s, p, sub)))).tobytes() for u, s, p, sub in self.parts)

    @classmethod
    def from_bytes(cls, data: bytes, n_anchors: int, n_targets: int, cfg: SnnConfig) -> Anchors:
        flat, at, parts = np.frombuffer(data), 0, []
        while at < len(flat):
            k = int(flat[at])
            u, s, p, sub, _ = np.split(flat[at + 1 :], np.cumsum([n_anchors * k, k, k * n_targets, n_targets]))
            parts.append((u.reshape(n_anchors, k), s, p.reshape(k, n_targets), sub))
            at += 1 + k * (n_anchors + 1 + n_targets) + n_targets
        return cls(parts, cfg)

    def fill(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predictions, feasible) of each target; y: the row's values on anchor columns."""
        cfg, preds, oks, weights = self.cfg, [], [], []
        for u, s, p, sub in self.parts:
            own = u.T @ y
            train = float(_ratio((u @ own - y)[:, None], y[:, None])[0])
            pred = (own / s) @ p
            if cfg.min_value is not None:
                pred = np.maximum(pred, cfg.min_value)
            if cfg.max_value is not None:
                pred = np.minimum(pred, cfg.max_value)
            ok = (train <= cfg.linear_span_eps) & (sub <= cfg.subspace_eps)
            error = train + sub
            w = np.ones(len(pred)) if cfg.weights == "uniform" else np.where(error > 0, 1 / np.where(error > 0, error, 1.0), np.finfo(float).max)
            preds.append(pred)
            oks.append(ok)
            weights.append(np.where(np.isfinite(error) | (cfg.weights == "uniform"), w, 0.0))
        w = np.array(weights)
        top = w.max(axis=0)
        w = np.where(top > 0, w / np.where(top > 0, top, 1.0), 1.0)
        return (np.array(preds) * w).sum(axis=0) / w.sum(axis=0), np.all(oks, axis=0)


def synthesise(y: np.ndarray, x1: np.ndarray, x2: np.ndarray, cfg: SnnConfig) -> list[tuple[float, bool]]:
    """(prediction, feasible) of each column: y row on anchor columns, x1 anchors, x2 anchor rows by columns."""
    values, ok = Anchors.of(x1, x2, cfg).fill(y)
    return [(float(p), bool(k)) for p, k in zip(values, ok, strict=True)]


def _predictor(cfg: SnnConfig):
    names = [x.split()[0] for x in FILLED.split(", ")]

    def run(frames):
        """Rows with their wanted columns of one pattern, and the regression that predicts them."""
        for f in frames:
            out = []
            for row, wanted, cols, vals, anchor_cols, targets, model, exact in zip(*(f[c] for c in ("row_id", "wanted", "cols", "vals", "anchor_cols", "targets", "model", "exact")), strict=True):
                value, ok = Anchors.from_bytes(model, len(anchor_cols), len(targets), cfg).fill(vals[np.searchsorted(cols, anchor_cols)])
                at = np.searchsorted(targets, wanted)
                out.append((np.full(len(wanted), row), wanted, value[at], ok[at], np.full(len(wanted), exact)))
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame({n: [] for n in names})

    return run


def row_lists(cells: DataFrame) -> DataFrame:
    """(row_id, cols, vals): known columns of each row, sorted, with their values."""
    own = F.sort_array(F.collect_list(F.struct("col_id", "value")))
    return cells.groupBy("row_id").agg(own.alias("own")).select("row_id", F.col("own.col_id").alias("cols"), F.col("own.value").alias("vals"))


def snn_impute(cells: DataFrame, missing: DataFrame, cfg: SnnConfig) -> DataFrame:
    """FILLED rows for ``missing`` pairs that have anchors; others are left out.

    ``cells``: (row_id, col_id, value) known; ``missing``: (row_id, col_id).
    """
    cells = cells.where("value is not null").select("row_id", "col_id", "value").persist()
    pairs = missing_patterns(missing.select("row_id", "col_id"), cells).persist()
    anchors = stored(find_anchors(pairs, cells, cfg), "anchors")
    work = pairs.groupBy("row_id", "row_pattern", "col_pattern").agg(F.sort_array(F.collect_list("col_id")).alias("wanted"))
    work = work.join(anchors, ["row_pattern", "col_pattern"]).join(row_lists(cells), "row_id")
    work = work.select("row_id", "wanted", "cols", "vals", "anchor_cols", "targets", "model", "exact")
    return work.mapInPandas(_predictor(cfg), FILLED)


Imputer = Callable[[DataFrame, DataFrame, object], DataFrame]
IMPUTERS: dict[str, Imputer] = {}


def register_imputer(name: str, impute: Imputer) -> None:
    """Extension point: ``impute(cells, missing, model_config)`` returns FILLED rows."""
    IMPUTERS[name] = impute


register_imputer("snn", lambda cells, missing, cfg: snn_impute(cells, missing, cfg.snn))
register_imputer("none", lambda cells, missing, cfg: missing.select("row_id", "col_id", F.lit(None).cast("double").alias("value"), F.lit(False).alias("feasible"), F.lit(True).alias("exact")).where("false"))
