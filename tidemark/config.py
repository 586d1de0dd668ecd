"""Roles of a dataset's columns, and the sizes of its stream. Parameters are part of what a score means."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class DataConfig:
    attributes: tuple[str, ...]
    label: str
    initial: int
    #: Rows of each later batch; of a nested one, of its mini-batches, which arrive one after another.
    batches: tuple[int | tuple[int, ...], ...]
    skip: int = 0
    stride: int = 1
    cap: int | None = None
    window: int = 100
    least_window: int = 7
    most_window: int = 365
    #: Rows on either side of a row in its moving average.
    arm: int = 25
    #: Uncertain rows, at least, that get components of their own.
    gmm_threshold: int = 200
    #: Latest rows, at least, that models are judged on.
    test_size: int = 500
    folds: int = 200
    train_rate: float = 0.7
    #: "logistic", or "radial" with its gamma.
    model: str = "logistic"
    gamma: float | None = None
    balanced: bool = True
    by_validation: bool = False
    z_scores: bool = False
    #: Earlier rows whose attributes are features of a row's model.
    lags: int = 0
    #: Names under which attributes are shown.
    names: Mapping[str, str] = field(default_factory=dict)
    mul: float = 1.0
    neighbours: int = 5
    #: Whether drift is scored by batches rather than by sliding windows.
    drift_of_batches: bool = False

    def __post_init__(self) -> None:
        if self.initial < 1 or not self.attributes:
            raise ValueError("a dataset needs attributes and first rows")

    def mini_bounds(self, n: int) -> list[list[tuple[int, int]]]:
        """[start, end) of the first rows and of each batch's mini-batches, as far as there are rows; the last one is cut."""
        found, at = [], 0
        for sizes in ((self.initial,), *(tuple(b) if isinstance(b, Sequence) else (b,) for b in self.batches)):
            minis = []
            for size in sizes:
                if at < n:
                    minis.append((at, min(n, at + size)))
                at += size
            if minis:
                found.append(minis)
        return found

    def bounds(self, n: int) -> list[tuple[int, int]]:
        """[start, end) of the first rows and each batch."""
        return [(minis[0][0], minis[-1][1]) for minis in self.mini_bounds(n)]


# Roles and sizes of three known datasets.
SYNTHETIC = DataConfig(attributes=("x1", "x2"), label="y", initial=500, batches=(500, 500, 500, 500))
WEATHER = DataConfig(
    attributes=("temp", "seaLevelPressure", "visibility", "avgWind", "dewPoint", "maxWind", "maxTemp", "minTemp"), label="rain", initial=90,
    batches=tuple((1,) * n for n in (15, 15, 23, 10, 17, 22, 15, 13, 24, 80, 41, 30, 75, 260, 365, 40, 105, 220, 365, *[365] * 6)),
    skip=150, cap=3000, window=30, arm=7, gmm_threshold=35, test_size=60, z_scores=True, lags=2,
)
PAPER = DataConfig(
    attributes=tuple(f"dim{k}" for k in range(10)), label="label", initial=152 + 197 + 207 + 198,
    batches=((207, 207, 204, 217), (250, 262, 292, 306), (368, 360, 411, 403), (569, 679, 1009), (1428,)),
    window=500, gmm_threshold=300, folds=3, model="radial", gamma=2**-3, balanced=False, mul=10.0, drift_of_batches=True,
    names={
        "dim0": "distribution,feature", "dim1": "image,object", "dim2": "policy,agent", "dim3": "inference,bayesian", "dim4": "node,tree",
        "dim5": "kernel,neuron", "dim6": "graph,node", "dim7": "regret,bound", "dim8": "matrix,rank", "dim9": "regret,bandit",
    },
)
DATASETS = {"synthetic": SYNTHETIC, "weather": WEATHER, "paper": PAPER}
