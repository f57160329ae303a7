"""Names of a panel's columns and the settings of every algorithm."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    """Columns of a long panel: one row for each (unit, time) with the action taken and the metric seen."""

    unit: str
    time: str
    actions: tuple[str, ...]
    metric: str
    covariates: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if isinstance(self.actions, str):
            object.__setattr__(self, "actions", (self.actions,))
        if not self.actions:
            raise ValueError("a panel needs at least one action column")
        names = [self.unit, self.time, *self.actions, self.metric, *self.covariates]
        if len(set(names)) != len(names):
            raise ValueError(f"column names repeat: {names}")


@dataclass(frozen=True)
class CpConfig:
    """Low-rank compression of the tensor."""

    rank: int = 5
    sweeps: int = 1000
    ridge: float = 1e-8
    tolerance: float = 1e-9
    seed: int = 0
    driver_cells: int = 2_000_000


@dataclass(frozen=True)
class SnnConfig:
    """Synthetic nearest neighbours."""

    n_neighbors: int = 1
    weights: str = "uniform"
    random_splits: bool = False
    max_rank: int | None = None
    spectral_t: float | None = None
    linear_span_eps: float = 0.1
    subspace_eps: float = 0.1
    min_value: float | None = None
    max_value: float | None = None
    min_singular_value: float = 1e-7
    #: Nodes that a search for anchors may visit; None: as many as an exact one takes.
    node_budget: int | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        if self.weights not in ("uniform", "distance"):
            raise ValueError(f"weights must be 'uniform' or 'distance', not {self.weights!r}")
        if self.n_neighbors < 1:
            raise ValueError("n_neighbors must be at least 1")


@dataclass(frozen=True)
class BiclusterConfig:
    """Biclustered synthetic nearest neighbours."""

    row_sparsity: float = 0.3
    column_sparsity: float = 0.3
    cluster_sparsity: float = 0.3
    min_cluster_size: int = 9
    clusterings: int = 3
    num_estimates: int = 3
    rank: int = 5
    linear_span_eps: float = 0.1
    subspace_eps: float = 0.1
    min_value: float | None = None
    max_value: float | None = None
    min_singular_value: float = 1e-7
    seed: int = 0


@dataclass(frozen=True)
class AlsConfig:
    """Masked low-rank imputation with a search for the rank."""

    ranks: tuple[int, ...] = (2, 3, 5, 7)
    held_out: float = 0.1
    sweeps: int = 200
    ridge: float = 1e-6
    driver_cells: int = 2_000_000
    min_value: float | None = None
    max_value: float | None = None
    seed: int = 0


@dataclass(frozen=True)
class MssaConfig:
    """Singular-spectrum forecasting of time factors, or another registered forecaster."""

    model: str = "mssa"
    lags: int = 10
    rank: int | None = None
    rank_rule: str = "donoho"
    energy: float = 0.95
    ar_order: int = 0
    page: bool = False
    column_nan_share: float = 0.3

    def __post_init__(self) -> None:
        if self.rank is None and self.rank_rule not in ("donoho", "energy", "fixed"):
            raise ValueError(f"unknown rank rule {self.rank_rule!r}")


@dataclass(frozen=True)
class ModelConfig:
    """Everything a panel model needs; saved with it."""

    imputer: str = "snn"
    L: int | None = None
    full_training_time_steps: int = 20
    threshold_multiplier: float = 10.0
    certainty: float = 0.5
    min_singular_value: float = 1e-7
    cp: CpConfig = field(default_factory=CpConfig)
    snn: SnnConfig = field(default_factory=SnnConfig)
    bicluster: BiclusterConfig = field(default_factory=BiclusterConfig)
    als: AlsConfig = field(default_factory=AlsConfig)
    mssa: MssaConfig = field(default_factory=MssaConfig)
