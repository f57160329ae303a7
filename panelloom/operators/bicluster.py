"""Biclustered synthetic nearest neighbours, and the masked low-rank imputer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.kernels import masked_cp, spectral_labels, truncated_svd
from panelloom.operators import cp
from panelloom.operators.panel import large_dimension
from panelloom.operators.snn import FILLED, register_imputer
from panelloom.sources.scratch import at_once, stored
from panelloom.spec import AlsConfig, BiclusterConfig

DRIVER_CELLS = 4_000_000


def block_filter(mask: DataFrame, row_limit: float = 0.3, column_limit: float = 0.3, cluster_limit: float = 0.3) -> DataFrame:
    """(cluster, row_id, col_id, seen) of blocks that stay: two passes of means over a 0/1 column ``seen``.

    Blocks seen for less than a fifth go; then columns with a mean at or below the limit, then rows of
    what is left, and at last blocks whose mean fell below the block limit.
    """
    dense = mask.groupBy("cluster").agg(F.avg("seen").alias("m")).where("m >= 0.2").select("cluster")
    d = mask.join(dense, "cluster")
    d = d.join(d.groupBy("cluster", "col_id").agg(F.avg("seen").alias("m")).where(F.col("m") > column_limit).select("cluster", "col_id"), ["cluster", "col_id"])
    d = d.join(d.groupBy("cluster", "row_id").agg(F.avg("seen").alias("m")).where(F.col("m") > row_limit).select("cluster", "row_id"), ["cluster", "row_id"])
    return d.join(d.groupBy("cluster").agg(F.avg("seen").alias("m")).where(F.col("m") >= cluster_limit).select("cluster"), "cluster")


def filtered(mask: np.ndarray, rows: np.ndarray, cols: np.ndarray, row_limit: float, column_limit: float, cluster_limit: float) -> tuple[np.ndarray, np.ndarray]:
    """``block_filter`` of one block of a 0/1 matrix, where it is found: its rows and columns that stay, none if it goes."""
    block = mask[np.ix_(rows, cols)]
    if block.mean() >= 0.2:
        keep = block.mean(axis=0) > column_limit
        block, cols = block[:, keep], cols[keep]
        if len(cols):
            keep = block.mean(axis=1) > row_limit
            block, rows = block[keep], rows[keep]
            if len(rows) and block.mean() >= cluster_limit:
                return rows, cols
    return rows[:0], cols[:0]


def match_clusters(pairs: DataFrame, cells: DataFrame, cluster_rows: DataFrame, cluster_cols: DataFrame, least: int = 9, top: int = 3) -> DataFrame:
    """(row_id, col_id, cluster, score, rank): the best clusters of each pair.

    score = (cluster rows known in the pair's column) * (cluster columns known in its row). Both counts
    depend on one end of the pair only, so they are aggregated for each end before pairs meet clusters.
    """
    by_col = cells.join(cluster_rows, "row_id").groupBy("cluster", "col_id").agg(F.count("*").alias("r"))
    by_row = cells.join(cluster_cols, "col_id").groupBy("cluster", "row_id").agg(F.count("*").alias("c"))
    scored = pairs.join(by_col, "col_id").join(by_row, ["row_id", "cluster"]).withColumn("score", F.col("r") * F.col("c")).where(F.col("score") >= least)
    order = Window.partitionBy("row_id", "col_id").orderBy(F.desc("score"), "cluster")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("row_id", "col_id", "cluster", "score", "rank")


def mask_groups(cells: DataFrame) -> int:
    """Groups of rows that a mask is clustered in: one if it has at most DRIVER_CELLS cells, none without cells."""
    dims = cells.agg(F.max("row_id").alias("r"), F.max("col_id").alias("c")).first()
    return 0 if dims["r"] is None else max(1, -(-(dims["r"] + 1) * (dims["c"] + 1) // DRIVER_CELLS))


def find_clusters(spark: SparkSession, cells: DataFrame, cfg: BiclusterConfig) -> tuple[DataFrame, DataFrame]:
    """(cluster, row_id) and (cluster, col_id): deduplicated, filtered blocks of several biclusterings.

    The 0/1 mask of the matrix is bounded by DRIVER_CELLS; beyond, rows are hashed into groups that
    keep it so, and each group is clustered for itself.
    """
    groups = mask_groups(cells)
    if not groups:
        empty = spark.createDataFrame([], "cluster int, row_id int, col_id int")
        return empty.select("cluster", "row_id"), empty.select("cluster", "col_id")
    def cluster(f: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(f["row_id"]), np.unique(f["col_id"])
        mask = np.zeros((len(rows), len(cols)), int)
        mask[np.searchsorted(rows, f["row_id"]), np.searchsorted(cols, f["col_id"])] = 1
        seen, out = set(), []
        small = int(np.sqrt(min(mask.shape)))
        for idx in range(cfg.clusterings):
            k = max(1, min(small + 2 * idx, *mask.shape))
            rl, cl = spectral_labels(mask, k, 6 + idx, 7 + idx, cfg.seed + idx)
            for a in np.unique(rl):
                for b in np.unique(cl):
                    r, c = np.flatnonzero(rl == a), np.flatnonzero(cl == b)
                    key = (r.tobytes(), c.tobytes())
                    if key in seen or mask[np.ix_(r, c)].mean() < 0.2:
                        continue
                    seen.add(key)
                    r, c = filtered(mask, r, c, cfg.row_sparsity, cfg.column_sparsity, cfg.cluster_sparsity)
                    number = int(f["part"].iloc[0]) * 100_000 + len(seen)
                    out += [pd.DataFrame({"cluster": number, "side": side, "id": ids}) for side, ids in (("row", rows[r]), ("col", cols[c]))]
        return pd.concat(out) if out else pd.DataFrame({"cluster": [], "side": [], "id": []})

    parts = cells.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(groups)).cast("int"))
    ends = stored(parts.groupBy("part").applyInPandas(cluster, "cluster int, side string, id int"), "clusters")
    return tuple(ends.where(F.col("side") == m).select("cluster", F.col("id").alias(f"{m}_id")) for m in ("row", "col"))


def sane(known: np.ndarray) -> bool:
    """Whether a block of anchors is known well enough: two cells in each column, two rows' worth of cells, a density of .3."""
    return bool(known.any()) and known.sum(axis=0).min() >= 2 and known.mean(axis=1).sum() >= 2 and known.mean() >= 0.3


def _dense(block: pd.DataFrame, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a block's cells in these rows and columns, and which of them are known."""
    d = block[block["row_id"].isin(rows) & block["col_id"].isin(cols)]
    at = np.searchsorted(rows, d["row_id"]), np.searchsorted(cols, d["col_id"])
    values, seen = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), bool)
    values[at], seen[at] = d["value"], True
    return values, seen


def _patterns(seen: np.ndarray) -> np.ndarray:
    """A number for each row, the same for the same rows."""
    bits = np.ascontiguousarray(np.packbits(seen, axis=1))
    return np.unique(bits.view(np.dtype((np.void, bits.shape[1]))).ravel(), return_inverse=True)[1]


def _shares(residual: np.ndarray, of: np.ndarray, axis: int) -> np.ndarray:
    """Squared ratios of norms along an axis; NaN where there is nothing to compare with."""
    norm = (of * of).sum(axis=axis)
    return np.where(norm > 0, (residual * residual).sum(axis=axis) / np.where(norm > 0, norm, 1.0), np.nan)


def _block_estimator(cfg: BiclusterConfig):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        """One cluster: its known cells (kind 0, in and next to the block) and the pairs it estimates (kind 1)."""
        block, pairs = f[f["kind"] == 0], f[f["kind"] == 1]
        rows, cols = np.unique(block.loc[block["member"] & 1 > 0, "row_id"]), np.unique(block.loc[block["member"] & 2 > 0, "col_id"])
        if not len(pairs) or not len(rows) or not len(cols):
            return pd.DataFrame({"row_id": [], "col_id": [], "value": [], "feasible": [], "exact": []})
        inner = block[block["row_id"].isin(rows) & block["col_id"].isin(cols)]
        index = [np.searchsorted(rows, inner["row_id"]), np.searchsorted(cols, inner["col_id"])]
        r, c = masked_cp(index, inner["value"].to_numpy(float), (len(rows), len(cols)), min(cfg.rank, len(rows), len(cols)), 100, 1e-10, 1e-12, cfg.seed)
        u, s, v = truncated_svd(r @ c.T, cfg.rank, cfg.min_singular_value)
        known = np.zeros((len(rows), len(cols)), bool)
        known[index[0], index[1]] = True
        # pairs whose rows know the same columns, and whose columns the same rows, share their anchors
        (prow, i), (pcol, j) = (np.unique(pairs[c], return_inverse=True) for c in ("row_id", "col_id"))
        y, y_seen = _dense(block, prow, cols)
        x2, x_seen = _dense(block, rows, pcol)
        row_pattern, col_pattern = _patterns(y_seen), _patterns(x_seen.T)
        out = []
        shared = row_pattern[i] * len(pcol) + col_pattern[j]
        order = np.argsort(shared, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(shared[order])) + 1):
            ac, ar = np.flatnonzero(y_seen[i[at[0]]]), np.flatnonzero(x_seen[:, j[at[0]]])
            if len(ac) < 2 or len(ar) < 2 or not sane(known[np.ix_(ar, ac)]):
                continue
            (ri, ni), (cj, nj) = np.unique(i[at], return_inverse=True), np.unique(j[at], return_inverse=True)
            own, there = y[np.ix_(ri, ac)], x2[np.ix_(ar, cj)]
            p, q, w = np.linalg.svd(v[:, ac].T @ (u[ar] * s).T, full_matrices=False)
            spanned = w[: min(cfg.rank, int((q >= cfg.min_singular_value).sum()))]
            some = q > cfg.min_singular_value * q[0]
            p, q, w = p[:, some], q[some], w[some]
            weights = own @ p
            train = _shares(own - weights @ p.T, own, 1)
            beyond = _shares(there - spanned.T @ (spanned @ there), there, 0)
            pred = ((weights / q)[ni] * (w @ there).T[nj]).sum(axis=1)
            pred = np.maximum(pred, cfg.min_value) if cfg.min_value is not None else pred
            pred = np.minimum(pred, cfg.max_value) if cfg.max_value is not None else pred
            out.append(pd.DataFrame({"row_id": prow[i[at]], "col_id": pcol[j[at]], "value": pred, "feasible": (train[ni] <= cfg.linear_span_eps) & (beyond[nj] <= cfg.subspace_eps)}))
        if not out:
            return pd.DataFrame({"row_id": [], "col_id": [], "value": [], "feasible": [], "exact": []})
        return pd.concat(out).assign(exact=True)

    return run


def bicluster_impute(cells: DataFrame, missing: DataFrame, cfg: BiclusterConfig) -> DataFrame:
    """FILLED rows: means of up to ``num_estimates`` clusters' estimates, feasible if one of them is.

    ``exact`` is false where the matrix was too large to be clustered as a whole.
    """
    spark = cells.sparkSession
    cells = cells.where("value is not null").select("row_id", "col_id", "value").persist()
    rows, cols = find_clusters(spark, cells.select("row_id", "col_id"), cfg)
    whole = mask_groups(cells) <= 1
    pairs = match_clusters(missing.select("row_id", "col_id"), cells, rows, cols, cfg.min_cluster_size, cfg.num_estimates)
    near_rows = cells.join(rows.withColumn("a", F.lit(1)), "row_id").select("cluster", "row_id", "col_id", "value", F.lit(1).alias("side"))
    near_cols = cells.join(cols.withColumn("b", F.lit(2)), "col_id").select("cluster", "row_id", "col_id", "value", F.lit(2).alias("side"))
    near = near_rows.unionByName(near_cols).groupBy("cluster", "row_id", "col_id").agg(F.first("value").alias("value"), F.sum("side").alias("member")).withColumn("kind", F.lit(0))
    work = near.select("cluster", "kind", "row_id", "col_id", "value", F.col("member").cast("int").alias("member")).unionByName(pairs.select("cluster", F.lit(1).alias("kind"), "row_id", "col_id", F.lit(None).cast("double").alias("value"), F.lit(0).alias("member")))
    estimates = work.groupBy("cluster").applyInPandas(_block_estimator(cfg), FILLED)
    return estimates.groupBy("row_id", "col_id").agg(F.avg("value").alias("value"), F.max("feasible").alias("feasible"), F.lit(whole).alias("exact"))


def als_impute(cells: DataFrame, missing: DataFrame, cfg: AlsConfig) -> DataFrame:
    """Low-rank fit of the known cells with the rank chosen on cells held out by a hash of their place.

    The same start, ridge, sweeps and tolerance at every size: matrices of at most ``driver_cells`` known
    cells are fitted by the kernel, larger ones by distributed normal equations. Every estimate counts as
    feasible; pairs whose row or column has no known cell get none.
    """
    spark = cells.sparkSession
    cells = cells.where("value is not null").select("row_id", "col_id", "value")

    def numbered(m: str) -> tuple[DataFrame, int]:
        d = large_dimension(cells.select(F.col(f"{m}_id").alias(m)), m).select(F.col(m).alias(f"{m}_id"), f"{m}_idx").persist()
        return d, d.count()

    (rows, n_rows), (cols, n_cols), n = at_once(lambda: numbered("row"), lambda: numbered("col"), cells.count)
    shape, few = (n_rows, n_cols), n_cols <= cp.OTHER_CELLS
    held = F.pmod(F.xxhash64("row_id", "col_id", F.lit(cfg.seed)), F.lit(1000)) < int(cfg.held_out * 1000)
    known = cells.withColumn("held", held).join(rows, "row_id").join(F.broadcast(cols) if few else cols, "col_id").select("row_idx", "col_idx", "value", "held")
    ranks = [r for r in cfg.ranks if r <= min(shape)] or [1]
    if few:
        split = cp.Split(spark, known, ("row", "col"), shape, cfg.driver_cells, n)
        best, factors = _chosen_fit(split, ranks, (cfg.sweeps, cfg.ridge, 1e-9, cfg.seed))
    else:
        best, factors = _chosen_fit_of_many_columns(spark, known.persist(), ranks, shape, cfg)
    # rows and columns meet their factors before the pairs meet them, once each
    ends = {m: d.join(factors[m].select(F.col("idx").alias(f"{m}_idx"), F.col("vec").alias(f"f_{m}")), f"{m}_idx").select(f"{m}_id", f"f_{m}") for m, d in (("row", rows), ("col", cols))}
    wanted = missing.select("row_id", "col_id").join(ends["row"], "row_id").join(F.broadcast(ends["col"]) if few else ends["col"], "col_id")
    value = F.col("value")
    for limit, clip in ((cfg.min_value, F.greatest), (cfg.max_value, F.least)):
        value = value if limit is None else clip(value, F.lit(float(limit)))
    found = wanted.withColumn("value", cp.product_sum([F.col("f_row"), F.col("f_col")], best))
    return found.select("row_id", "col_id", value.alias("value"), F.lit(True).alias("feasible"), F.lit(True).alias("exact"))


def _chosen_fit(split: cp.Split, ranks: list[int], settings: tuple) -> tuple[int, dict[str, DataFrame]]:
    """(the rank with the least error on held cells, factors of all cells of that rank)."""
    best = ranks[0]
    if len(ranks) > 1 and split.learnt and split.held:
        train = split.train()
        best = min(ranks, key=lambda rank: split.error(train, rank, *settings))
        train.unpersist()
    whole = split.whole()
    factors = whole.fit(best, *settings)
    whole.unpersist()
    split.unpersist()
    return best, factors


def _chosen_fit_of_many_columns(spark: SparkSession, known: DataFrame, ranks: list[int], shape: tuple[int, int], cfg: AlsConfig) -> tuple[int, dict[str, DataFrame]]:
    """``_chosen_fit`` where sums by column don't fit the driver."""
    train, test = known.where("not held").drop("held").persist(), known.where("held").drop("held").persist()

    def packed(d: DataFrame) -> cp.Packed:
        return cp.Packed(spark, d, ("row", "col"), shape, cfg.driver_cells)

    def fitted(cells: cp.Packed, rank: int) -> dict[str, DataFrame]:
        return cells.fit(rank, cfg.sweeps, cfg.ridge, 1e-9, cfg.seed)

    def error(rank: int) -> float:
        d = cp.evaluate(test, cp.factors_table(fitted(learnt, rank)), "fitted", ("row", "col"), rank)
        return d.agg(F.avg(F.pow(F.col("fitted") - F.col("value"), 2))).first()[0]

    best = None
    if len(ranks) > 1 and not train.isEmpty() and not test.isEmpty():
        learnt = packed(train)
        best = min(ranks, key=error)
        learnt.unpersist()
    best = best or ranks[0]
    whole = packed(known.drop("held"))
    factors = fitted(whole, best)
    whole.unpersist()
    return best, factors


register_imputer("snn_bicluster", lambda cells, missing, cfg: bicluster_impute(cells, missing, cfg.bicluster))
register_imputer("als", lambda cells, missing, cfg: als_impute(cells, missing, cfg.als))
