"""CP (low-rank) compression of sparse tensors and evaluation of its factors.

Factors are a table (mode: 'unit' | 'time' | 'action', idx, vec). Tensors and matrices are fitted by alternating
least squares over blocks of cells: a block holds all cells of some indices of the first mode (units, rows), so
that it solves for their factors by itself and leaves only sums by the cells of the other modes (time steps by
actions, columns), from which the driver solves for the others and knows the error. Few cells are swept on the
driver, more of them in Spark, in one job for all sweeps or for each. Where the other modes have too many cells for that, sweeps are
aggregations of normal equations. All begin with the same factors and end by the same rule.

Where the blocks fit the tasks that can run at once, all sweeps are one job, whose tasks keep their blocks and
exchange sums; where tasks can't reach each other, each sweep is a job. Complete rows are swept by the triangle that has their inner products.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.kernels import column_sums, factor_error, normalised, row_factors, upper_solve
from panelloom.functions.links import Links
from panelloom.operators.layout import vector_product, vector_sum
from panelloom.sources.scratch import stored
from panelloom.spec import CpConfig

FACTORS = "mode string, idx int, vec array<double>"
MODES = ("unit", "time", "action")
#: Modes whose dictionaries are small by nature, so that their factors are.
SMALL_MODES = ("time", "action")
#: Known cells of a block, about; cells of all modes but the first up to which sums by them go to the driver; MB of a sweep's sums.
BLOCK_CELLS, OTHER_CELLS, SUMS_MB = 65_536, 100_000, 64
#: Cells of a partition that packs them; MB of blocks that a task may keep; cells of a complete row up to which a triangle stands for such rows.
PART_CELLS, KEPT_MB, TRIANGLE = 4_000_000, 128, 1000
BLOCKS = "first binary, other binary, value binary"
#: Shares of the mean square below which the error is summed from differences: as a difference of sums it would be lost in them.
SMALL_ERROR = 1e-4


def factor_rows(spark: SparkSession, factors: list[np.ndarray], offsets: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    rows = [(mode, i + at, f.tolist()) for mode, fs, at in zip(MODES, factors, offsets, strict=True) for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, FACTORS)


def factor_arrays(factors: DataFrame) -> dict[str, np.ndarray]:
    """Factors as arrays by mode, for models that fit the driver."""
    rows = factors.toPandas().sort_values(["mode", "idx"])
    return {m: np.stack(g["vec"].to_numpy()) for m, g in rows.groupby("mode")}


def of_mode(factors: DataFrame, mode: str, name: str) -> DataFrame:
    return factors.where(F.col("mode") == mode).select(F.col("idx").alias(f"{mode}_idx"), F.col("vec").alias(name))


def fit_cp(spark: SparkSession, cells: DataFrame, cfg: CpConfig, shape: tuple[int, int, int], start: int = 0) -> DataFrame:
    """Factors of ``cells`` (unit_idx, time_idx, action_idx, value); time starts at ``start``."""
    known = cells.where("value is not null").select("unit_idx", (F.col("time_idx") - start).cast("int").alias("time_idx"), "action_idx", "value")
    return factors_table(fit_low_rank(spark, known, MODES, shape, cfg.rank, cfg.sweeps, cfg.ridge, cfg.tolerance, cfg.seed, cfg.driver_cells), {"time": start})


def normal_equations(cells: DataFrame, mode: str, others: dict[str, DataFrame], rank: int) -> DataFrame:
    """(idx, gram array, side array): sums of z z^T (upper half) and z y over known cells of each index."""
    d = cells
    for name, table in others.items():
        d = d.join(table.select(F.col("idx").alias(f"{name}_idx"), F.col("vec").alias(f"f_{name}")), f"{name}_idx")
    d = d.withColumn("z", vector_product(*[F.col(f"f_{n}") for n in others]))
    z = [F.col("z")[a] for a in range(rank)]
    grams = [F.sum(z[a] * z[b]) for a in range(rank) for b in range(a, rank)]
    return d.groupBy(F.col(f"{mode}_idx").alias("idx")).agg(F.array(*grams).alias("gram"), F.array(*[F.sum(x * F.col("value")) for x in z]).alias("side"))


def _solver(rank: int, weight: float):
    upper = np.triu_indices(rank)

    def run(frames):
        for f in frames:
            vecs = []
            for gram, side in zip(f["gram"], f["side"], strict=True):
                g = np.zeros((rank, rank))
                g[upper] = gram
                g = g + np.triu(g, 1).T
                lam = weight * max(1e-12, np.trace(g) / rank)
                vecs.append(np.linalg.solve(g + (lam + 1e-300 + (lam == 0)) * np.eye(rank), np.asarray(side)).tolist())
            yield pd.DataFrame({"idx": f["idx"], "vec": vecs})

    return run


def _even(factors: dict[str, DataFrame], rank: int) -> dict[str, DataFrame]:
    """``normalised`` of factor tables; only sums of each component come to the driver."""
    one = [f.agg(*[g(F.col("vec")[k], k) for k in range(rank) for g in (lambda v, k: F.sum(v * v).alias(f"s{k}"), lambda v, k: F.sum(v).alias(f"t{k}"))]).first() for f in factors.values()]
    norms = np.sqrt(np.array([[r[f"s{k}"] or 0.0 for k in range(rank)] for r in one]))
    norms[norms == 0] = 1
    scale = np.prod(norms, axis=0) ** (1 / len(norms)) / norms
    for m, r in enumerate(one[1:], 1):
        sign = np.where(np.array([r[f"t{k}"] or 0.0 for k in range(rank)]) < 0, -1.0, 1.0)
        scale[m] *= sign
        scale[0] *= sign
    return {mode: f.select("idx", F.array(*[F.col("vec")[k] * F.lit(float(x)) for k, x in enumerate(row)]).alias("vec")) for (mode, f), row in zip(factors.items(), scale, strict=True)}


def distributed_als(spark: SparkSession, cells: DataFrame, modes: tuple[str, ...], shape: tuple[int, ...], rank: int, sweeps: int, ridge: float, tolerance: float, seed: int) -> dict[str, DataFrame]:
    """``masked_cp`` as aggregations: the same start, ridge and test of convergence; factors are checkpointed as they are made.

    ``cells`` has an index ``<mode>_idx`` for each mode, and value; an index without known cells has zeros.
    """
    rng = np.random.default_rng(seed)
    # a sweep solves for the first mode first, so that its start is never read: its draws are passed over
    rng.bit_generator.advance(shape[0] * rank)
    factors = {m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.uniform(0.5, 1.5, (n, rank)))], "idx int, vec array<double>") for m, n in zip(modes[1:], shape[1:], strict=True)}
    cells = cells.persist()
    square = cells.agg(F.avg(F.col("value") * F.col("value"))).first()[0] or 0.0
    weight = ridge * max(1.0, square) ** (1 / len(modes))
    last = np.inf
    for _ in range(sweeps):
        for mode in modes:
            parts = normal_equations(cells, mode, {m: factors[m] for m in modes if m != mode}, rank)
            factors[mode] = parts.mapInPandas(_solver(rank, weight), "idx int, vec array<double>").checkpoint()
        error = evaluate(cells, factors_table(factors), "fitted", modes).agg(F.avg(F.pow(F.col("fitted") - F.col("value"), 2))).first()[0] or 0.0
        if last - error <= tolerance * max(error, 1e-12):
            break
        last = error
    cells.unpersist()
    zeros = F.array(*[F.lit(0.0)] * rank)
    even = _even({m: factors[m] for m in modes}, rank)
    return {m: spark.range(n).select(F.col("id").cast("int").alias("idx")).join(even[m], "idx", "left").select("idx", F.coalesce("vec", zeros).alias("vec")) for m, n in zip(modes, shape, strict=True)}


def factors_table(factors: dict[str, DataFrame], offsets: dict[str, int] | None = None) -> DataFrame:
    """FACTORS of one table for each mode, with indices moved by ``offsets``."""
    parts = [f.select(F.lit(m).alias("mode"), (F.col("idx") + (offsets or {}).get(m, 0)).cast("int").alias("idx"), "vec") for m, f in factors.items()]
    return reduce(DataFrame.unionByName, parts)


def fit_matrix(spark: SparkSession, cells: DataFrame, shape: tuple[int, int], rank: int, sweeps: int, ridge: float, tolerance: float, seed: int, driver_cells: int) -> DataFrame:
    """Factors (modes row and col) of known cells (row_idx, col_idx, value)."""
    return factors_table(fit_low_rank(spark, cells, ("row", "col"), shape, rank, sweeps, ridge, tolerance, seed, driver_cells))


def fit_low_rank(spark: SparkSession, cells: DataFrame, modes: tuple[str, ...], shape: tuple[int, ...], rank: int, sweeps: int, ridge: float, tolerance: float, seed: int, driver_cells: int) -> dict[str, DataFrame]:
    """Factors (idx, vec) of each mode; an index without known cells has zeros.

    ``cells`` has an index ``<mode>_idx`` for each mode, and value. At most ``driver_cells`` of them are swept on the driver.
    """
    packed = Packed(spark, cells, modes, shape, driver_cells)
    factors = packed.fit(rank, sweeps, ridge, tolerance, seed)
    packed.unpersist()
    return factors


class Packed:
    """Cells in blocks, for any number of fits; beyond ``driver_cells`` complete rows are swept by their triangle."""

    def __init__(self, spark: SparkSession, cells: DataFrame, modes: tuple[str, ...], shape: tuple[int, ...], driver_cells: int, of: tuple[DataFrame, int, float] | None = None) -> None:
        """``of``: blocks of the cells, how many they are and their mean square, where they were packed before."""
        self.spark, self.cells, self.modes, self.shape, self.others = spark, cells, modes, shape, int(np.prod(shape[1:]))
        if self.others > OTHER_CELLS:
            return
        if of is None:
            self.n, square = cells.agg(F.count("value"), F.avg(F.col("value") * F.col("value"))).first()
            self.square = square or 0.0
            self.blocks = _packed(spark, cells, modes, shape, self.n).persist()
        else:
            blocks, self.n, self.square = of
            self.blocks = blocks.persist()
        self.swept, size = self.blocks, self.n
        if self.n > driver_cells and self.others <= TRIANGLE:
            self.swept = self.blocks.mapInArrow(_reducer(self.others), BLOCKS).persist()
            size = self.swept.agg(F.sum(F.octet_length("value"))).first()[0] // 8
        self.size, self.here = size, size <= driver_cells
        # each partition has its triangle: they become one before they come to the driver
        wanted = self.swept if self.swept is self.blocks else self.swept.repartition(1).mapInArrow(_reducer(self.others), BLOCKS)
        self.kept = _collected(wanted) if self.here else []

    def unpersist(self) -> None:
        if self.others > OTHER_CELLS:
            return
        self.blocks.unpersist()
        self.swept.unpersist()

    def _swept(self, rank: int, **settings) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        if self.here:
            return _sweeps(_Passes(self.kept, self.others, rank), **settings)
        tasks = min(_slots(self.spark), -(-self.size // BLOCK_CELLS))
        sums = 8 * self.others * rank * (rank + 3) // 2
        if tasks > 1 and 16 * self.size <= KEPT_MB * 1_000_000 * tasks and sums * tasks * tasks <= SUMS_MB * 1_000_000:
            done = self.swept.repartition(tasks).mapInArrow(_sweeper(self.others, rank, settings), "done binary", barrier=True)
            found = done.collect()
            if found:
                return pickle.loads(found[0]["done"])
        return _sweeps(_ClusterPasses(self.swept, self.others, rank), **settings)

    def _solved(self, rank: int, sweeps: int, ridge: float, tolerance: float, seed: int) -> tuple:
        weight = ridge * max(1.0, self.square) ** (1 / len(self.modes))
        return *self._swept(rank, shape=self.shape, n=self.n, square=self.square, weight=weight, sweeps=sweeps, tolerance=tolerance, seed=seed), weight

    def fit(self, rank: int, sweeps: int, ridge: float, tolerance: float, seed: int) -> dict[str, DataFrame]:
        modes, shape = self.modes, self.shape
        if self.others > OTHER_CELLS:
            return distributed_als(self.spark, self.cells, modes, shape, rank, sweeps, ridge, tolerance, seed)
        factors, norms, before, weight = self._solved(rank, sweeps, ridge, tolerance, seed)
        lengths = np.array([np.sqrt(norms), *[np.linalg.norm(f, axis=1) for f in factors]])
        lengths[lengths == 0] = 1
        scale = np.prod(lengths, axis=0) ** (1 / len(modes)) / lengths
        for f, own in zip(factors, scale[1:], strict=True):
            sign = np.where(f.sum(axis=1) < 0, -1.0, 1.0)
            own *= sign
            scale[0] *= sign
        rows = stored(self.blocks.mapInArrow(_row_writer(before, weight, scale[0]), "idx int, vec array<double>"), "factors")
        zeros = F.array(*[F.lit(0.0)] * rank)
        first = self.spark.range(shape[0]).select(F.col("id").cast("int").alias("idx")).join(rows, "idx", "left").select("idx", F.coalesce("vec", zeros).alias("vec"))
        # as Arrow tables they have a size that the optimizer knows
        rest = [self.spark.createDataFrame(pa.table({"idx": pa.array(range(f.shape[1]), pa.int32()), "vec": (f * x[:, None]).T.tolist()})) for f, x in zip(factors, scale[1:], strict=True)]
        return dict(zip(modes, [first, *rest], strict=True))


class Split:
    """Cells with a column ``held``, packed once: fits of those that aren't held, judged by those that are, and of all."""

    def __init__(self, spark: SparkSession, cells: DataFrame, modes: tuple[str, ...], shape: tuple[int, ...], driver_cells: int, n: int) -> None:
        self.settings = spark, cells, modes, shape, driver_cells
        self.marked = _packed(spark, cells, modes, shape, n).persist()
        parts = self.marked.mapInArrow(_sizes, "n long, square double, held_n long, held_square double")
        n, square, self.held, held_square = (x or 0 for x in parts.agg(*[F.sum(c) for c in parts.columns]).first())
        self.learnt, self.n, self.square = n - self.held, n, square
        self.train_square = square - held_square

    def train(self) -> Packed:
        return Packed(*self.settings, of=(self.marked.mapInArrow(_chosen(False), BLOCKS), self.learnt, self.train_square / max(1, self.learnt)))

    def whole(self) -> Packed:
        return Packed(*self.settings, of=(self.marked.mapInArrow(_chosen(True), BLOCKS), self.n, self.square / max(1, self.n)))

    def error(self, train: Packed, *settings) -> float:
        """Mean squared error of the held cells for a fit of the others; an index without one of those has zeros."""
        factors, _, before, weight = train._solved(*settings)
        return self.marked.mapInArrow(_held_error(before, _cross(factors), weight), "error double").agg(F.sum("error")).first()[0] / self.held

    def unpersist(self) -> None:
        self.marked.unpersist()


def _sizes(batches):
    for batch in batches:
        for row in batch.to_pylist():
            _, other, value = _arrays(row)
            held = value[other < 0]
            yield pa.RecordBatch.from_pydict({"n": [len(value)], "square": [float(value @ value)], "held_n": [len(held)], "held_square": [float(held @ held)]})


def _chosen(all_cells: bool):
    """Blocks without marks, of all cells or of those that aren't held."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first, other, value = _arrays(row)
                if all_cells:
                    yield _batch([(first, np.where(other < 0, ~other, other), value)])
                elif (other >= 0).any():
                    yield _batch([tuple(x[other >= 0] for x in (first, other, value))])

    return run


def _held_error(before: np.ndarray, z: np.ndarray, weight: float):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first, other, value = _arrays(row)
                held = other < 0
                if held.any():
                    fitted = np.zeros(int(held.sum()))
                    if not held.all():
                        ids, vecs = row_factors(first[~held], other[~held], value[~held], before, weight)
                        at = np.minimum(np.searchsorted(ids, first[held]), len(ids) - 1)
                        fitted = sum(v[at] * c[~other[held]] for v, c in zip(vecs, z, strict=True)) * (ids[at] == first[held])
                    d = fitted - value[held]
                    yield pa.RecordBatch.from_pydict({"error": [float(d @ d)]})

    return run


def _sweeps(passes: _Passes, shape: tuple[int, ...], n: int, square: float, weight: float, sweeps: int, tolerance: float, seed: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(factors of all modes but the first, squared norms of the first's, the products from which the first's were solved for)."""
    rank = passes.rank
    factors = _start(shape, rank, seed)
    last, norms = np.inf, np.zeros(rank)
    z = before = _cross(factors)
    for _ in range(sweeps if n else 0):
        before = z
        sums, norms = passes.sums(z, weight)
        gram, side = sums[:-rank].reshape(-1, *shape[1:]), sums[-rank:].reshape(-1, *shape[1:])
        for k in range(len(factors)):
            factors[k] = _other_factor(gram, side, factors, k, weight)
        z = _cross(factors)
        pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
        square_fitted = sum((1 if a == b else 2) * float(z[a] * z[b] @ g) for (a, b), g in zip(pairs, sums[:-rank], strict=True))
        error = square + (square_fitted - 2 * float((z * sums[-rank:]).sum())) / n
        if error < SMALL_ERROR * square:
            error = passes.error(before, z, weight) / n
        if last - error <= tolerance * max(error, 1e-12):
            break
        last = error
    return factors if n else [f * 0 for f in factors], norms, before


def _start(shape: tuple[int, ...], rank: int, seed: int) -> list[np.ndarray]:
    """The start of all modes but the first, components first; the first mode's is never read, its draws are passed over."""
    rng = np.random.default_rng(seed)
    rng.bit_generator.advance(shape[0] * rank)
    return [rng.uniform(0.5, 1.5, (n, rank)).T for n in shape[1:]]


def _cross(factors: list[np.ndarray]) -> np.ndarray:
    """Products of the factors' components at each combination of their indices: (rank, combinations)."""
    out = factors[0]
    for f in factors[1:]:
        out = (out[:, :, None] * f[:, None, :]).reshape(len(out), -1)
    return np.ascontiguousarray(out)


def _other_factor(gram: np.ndarray, side: np.ndarray, factors: list[np.ndarray], k: int, weight: float) -> np.ndarray:
    """The least squares factor of mode ``k`` of the others, from sums over the first mode at each combination of their indices."""
    rank, axes = len(side), [i for i in range(len(factors)) if i != k]
    o = np.ones((rank, *[1] * len(factors)))
    for i in axes:
        o = o * factors[i].reshape(rank, *[-1 if j == i else 1 for j in range(len(factors))])
    pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
    gone = tuple(axes)
    grams = np.stack([(g * o[a] * o[b]).sum(axis=gone) for (a, b), g in zip(pairs, gram, strict=True)])
    return upper_solve(grams, (side * o).sum(axis=tuple(i + 1 for i in axes)), weight).T


def _packed(spark: SparkSession, cells: DataFrame, modes: tuple[str, ...], shape: tuple[int, ...], n: int) -> DataFrame:
    """Blocks (first, other, value) of arrays as bytes, sorted by the index of the first mode; other: the others' combined
    index, its complement where ``held`` is true, if the cells have that column."""
    other = reduce(lambda x, m: x * shape[modes.index(m)] + F.col(f"{m}_idx"), modes[2:], F.col(f"{modes[1]}_idx"))
    size = BLOCK_CELLS
    span = max(1, size * shape[0] // max(1, n))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shape[0] // span)), -(-n // PART_CELLS))
    other = other.cast("int")
    if "held" in cells.columns:
        other = F.when(F.col("held"), F.bitwise_not(other)).otherwise(other)
    d = cells.select(F.col(f"{modes[0]}_idx").cast("int").alias("first"), other.alias("other"), F.col("value").cast("double").alias("value"))

    def pack(batches):
        table = pa.Table.from_batches(batches)
        first, other, value = (c.to_numpy() for c in table.columns)
        order = np.lexsort((np.where(other < 0, ~other, other), first))
        first, other, value = first[order], other[order], value[order]
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        # a row whole, in the block in which it begins
        cuts = starts[np.flatnonzero(np.diff(starts // size, prepend=-1))]
        for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True):
            yield _batch([(first[a:b], other[a:b], value[a:b])])

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from pack(batches)

    return d.repartition(parts, F.floor(F.col("first") / span)).mapInArrow(run, BLOCKS)


def _batch(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kinds = (np.int32, np.int32, np.float64)
    return pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for xs, kind in zip(zip(*blocks, strict=True), kinds, strict=True)], ["first", "other", "value"])


def reduced(blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], others: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with the same sums and errors: complete rows enter them by their inner products alone, which those of
    the triangle of their QR decomposition share, so that it stands for any number of them."""
    out, full, n = [], [], 0
    for first, other, value in blocks:
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        sizes = np.diff(starts, append=len(first))
        complete = sizes == others
        complete[complete] = (other[starts[complete][:, None] + np.arange(others)] == np.arange(others)).all(axis=1)
        whole = np.repeat(complete, sizes)
        if whole.any():
            full.append(value[whole].reshape(-1, others))
            n += len(full[-1])
            if n > 8 * others:
                full = [np.linalg.qr(np.vstack(full), mode="r")]
                n = len(full[0])
        if not whole.all():
            out.append((first[~whole], other[~whole], value[~whole]))
    if full:
        x = np.vstack(full)
        x = np.linalg.qr(x, mode="r") if len(x) > others else x
        out.append((np.repeat(np.arange(len(x), dtype=np.int32), others), np.tile(np.arange(others, dtype=np.int32), len(x)), x.ravel()))
    return out


def _reducer(others: int):
    def run(batches):
        for block in reduced((_arrays(row) for batch in batches for row in batch.to_pylist()), others):
            yield _batch([block])

    return run


def _slots(spark: SparkSession) -> int:
    """Tasks that run at once and can wait for each other; none where executors come and go."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def _sweeper(others: int, rank: int, settings: dict):
    """All sweeps in one job: each task keeps its blocks, and tasks tell each other their sums."""

    def run(batches):
        blocks = [_arrays(row) for batch in batches for row in batch.to_pylist()]
        with Links(BarrierTaskContext.get()) as links:
            if not links.all:
                return
            done = _sweeps(_SharedPasses(reduced(blocks, others) if others <= TRIANGLE else blocks, others, rank, links), **settings)
        if links.me == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(done)], pa.binary())], ["done"])

    return run


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["first"], np.int32), np.frombuffer(row["other"], np.int32), np.frombuffer(row["value"], np.float64)


def _collected(blocks: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks on the driver: views of Arrow's buffers, which pass through the JVM without rows or pickled copies."""
    kinds = (np.int32, np.int32, np.float64)
    batches = blocks.toArrow().to_batches()
    return [tuple(np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(b.columns, kinds, strict=True)) for b in batches for i in range(b.num_rows)]


def _row_writer(z: np.ndarray, weight: float, scale: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, vecs = row_factors(*_arrays(row), z, weight)
                flat = pa.array(np.ascontiguousarray((vecs * scale[:, None]).T).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(z)), flat)], ["idx", "vec"])

    return run


class _Passes:
    """Passes over blocks that lie here."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], others: int, rank: int) -> None:
        self.blocks, self.others, self.rank = blocks, others, rank

    def _run(self, of, size: int) -> np.ndarray:
        return reduce(np.add, (of(b) for b in self.blocks), np.zeros(size))

    def sums(self, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
        size = self.others * self.rank * (self.rank + 3) // 2 + self.rank
        flat = self._run(lambda b: np.concatenate([x.ravel() for x in column_sums(*b, z, weight)]), size)
        return flat[: -self.rank].reshape(-1, self.others), flat[-self.rank :]

    def error(self, before: np.ndarray, z: np.ndarray, weight: float) -> float:
        return float(self._run(lambda b: np.array([factor_error(*b, before, z, weight)]), 1)[0])


class _SharedPasses(_Passes):
    """Passes over the blocks of all tasks of a stage that run at once."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], others: int, rank: int, links: Links) -> None:
        super().__init__(blocks, others, rank)
        self.links = links

    def _run(self, of, size: int) -> np.ndarray:
        return self.links.total(super()._run(of, size))


class _ClusterPasses(_Passes):
    """Passes over blocks that the executors keep: a job each, of which sums come back."""

    def __init__(self, blocks: DataFrame, others: int, rank: int) -> None:
        size = 8 * others * rank * (rank + 3) // 2
        # a task costs more than a block's pass: one for each core, as long as their sums fit
        super().__init__(blocks.coalesce(max(1, min(blocks.sparkSession.sparkContext.defaultParallelism, SUMS_MB * 1_000_000 // size))), others, rank)

    def _run(self, of, size: int) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                for row in batch.to_pylist():
                    out = of(_arrays(row))
                    total = out if total is None else total + out
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return reduce(np.add, (np.frombuffer(r["sums"]) for r in self.blocks.mapInArrow(run, "sums binary").collect()))


def evaluate(coordinates: DataFrame, factors: DataFrame, value: str = "value", modes: tuple[str, ...] = MODES, rank: int | None = None) -> DataFrame:
    """``coordinates`` with the sum over components of unit * time * action (or of other modes); given the ``rank``, by compiled code."""
    d = coordinates
    for mode in modes:
        f = of_mode(factors, mode, f"f_{mode}")
        d = d.join(F.broadcast(f) if mode in SMALL_MODES else f, f"{mode}_idx")
    return d.withColumn(value, product_sum([F.col(f"f_{m}") for m in modes], rank)).drop(*[f"f_{m}" for m in modes])


def product_sum(vectors: list[Column], rank: int | None = None) -> Column:
    if rank is None:
        return vector_sum(vector_product(*vectors))
    return reduce(lambda s, k: s + reduce(lambda x, v: x * v[k], vectors[1:], vectors[0][k]), range(rank), F.lit(0.0))


def mean_drift(obs: DataFrame, factors: DataFrame, rank: int | None = None) -> DataFrame:
    """One row ``mean_drift``: twice the mean squared error over the mean square of known cells."""
    d = evaluate(obs, factors, "fitted", rank=rank)
    return d.agg((2 * F.avg(F.pow(F.col("fitted") - F.col("value"), 2)) / F.avg(F.pow("value", 2))).alias("mean_drift"))


def _time_solver(rank: int, least: float):
    upper = np.triu_indices(rank)

    def run(frames):
        for f in frames:
            vecs = []
            for gram, side in zip(f["gram"], f["side"], strict=True):
                g = np.zeros((rank, rank))
                g[upper] = gram
                g = g + np.triu(g, 1).T
                vecs.append((np.linalg.pinv(g, rcond=least) @ np.asarray(side)).tolist())
            yield pd.DataFrame({"idx": f["idx"], "vec": vecs})

    return run


def new_time_factors(obs: DataFrame, factors: DataFrame, rank: int, least: float = 1e-7) -> DataFrame:
    """Factors of new time steps by least squares on their known cells, each step on its own."""
    others = {m: factors.where(F.col("mode") == m).select("idx", "vec") for m in ("unit", "action")}
    parts = normal_equations(obs.where("value is not null"), "time", others, rank)
    return parts.mapInPandas(_time_solver(rank, least), "idx int, vec array<double>").select(F.lit("time").alias("mode"), "idx", "vec")


__all__ = ["Packed", "Split", "distributed_als", "evaluate", "factor_arrays", "factor_rows", "factors_table", "fit_cp", "fit_low_rank", "fit_matrix", "mean_drift", "new_time_factors", "normal_equations", "normalised", "of_mode", "product_sum"]
