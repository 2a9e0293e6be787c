"""Parameters of a forecast run."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ForecastConfig:
    """Defaults follow the published method; every defect of it that matters is a parameter here."""

    horizon: int = 10
    l1_ratio: float = 0.5
    train_window: int = 90
    selection_window: int = 120
    stride: int = 14
    top: int = 20
    min_frequency: float = 0.05
    floor_lookback: int = 90
    floor_quantile: float = 0.05
    cap: float | None = 10.0
    folds: int = 5
    n_alphas: int = 100
    #: Rows before the origin whose target may not be used yet: 0 as published, 3 as the reporting delay demands.
    label_lag: int = 0
    #: Up to this horizon the rolling model stands alone, beyond it it is averaged with the global one.
    rolling_only: int = 5
    origin_start: str | None = None
    origin_end: str | None = None

    def with_(self, **changes) -> ForecastConfig:
        return replace(self, **changes)
