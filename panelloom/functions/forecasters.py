"""What a forecaster of one series must offer, and the registry of those that a model may name."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np

from panelloom.functions.kernels import mssa_fit, mssa_predict
from panelloom.spec import MssaConfig


class SeriesModel(ABC):
    """A forecaster of one series: fitted, lengthened, asked for steps ahead. Unknown values are NaN."""

    #: Whether ``update`` keeps what was fitted, and whether one fit serves all horizons.
    updatable = False
    one_shot = True

    @abstractmethod
    def fit(self, series: np.ndarray) -> SeriesModel: ...

    @abstractmethod
    def predict(self, steps: int) -> np.ndarray: ...

    def update(self, series: np.ndarray) -> SeriesModel:
        """Go on after ``series``; models that can't be updated must be fitted again."""
        raise NotImplementedError(f"{type(self).__name__} can't be updated")


class SingularSpectrum(SeriesModel):
    """Singular-spectrum forecasts: coefficients from the fit, recursion over the latest history."""

    updatable = True

    def __init__(self, cfg: MssaConfig) -> None:
        self.cfg, self.history, self.coefs = cfg, np.zeros(0), np.zeros(0)

    def fit(self, series: np.ndarray) -> SingularSpectrum:
        c = self.cfg
        if np.ndim(series) != 1 or len(series) < 2:
            raise ValueError("a series has one dimension and two steps at least")
        self.coefs = mssa_fit(np.asarray(series, float), c.lags, c.rank, c.rank_rule, c.energy, c.page, c.column_nan_share, c.ar_order)[0]
        self.history = np.asarray(series, float)
        return self

    def update(self, series: np.ndarray) -> SingularSpectrum:
        if not len(self.coefs):
            raise ValueError("fit the model first")
        self.history = np.concatenate((self.history, np.asarray(series, float)))
        return self

    def predict(self, steps: int) -> np.ndarray:
        return mssa_predict(self.history, self.coefs, steps)


FACTORIES: dict[str, Callable[[MssaConfig], SeriesModel]] = {}


def register_forecaster(name: str, factory: Callable[[MssaConfig], SeriesModel]) -> None:
    """Extension point: models whose ``MssaConfig.model`` is ``name`` forecast with what the factory makes."""
    FACTORIES[name] = factory


register_forecaster("singular_spectrum", SingularSpectrum)
