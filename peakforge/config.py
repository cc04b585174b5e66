"""Settings of a search and of training."""

from __future__ import annotations

from dataclasses import dataclass, fields

ION_MODES = ("positive", "negative")


@dataclass(frozen=True)
class SearchSettings:
    """``filter_on_ion_mode``: queries of another ion mode are skipped; null modes pass."""

    n_analogs: int = 1
    min_score: float = 0.0
    metadata_columns: tuple[str, ...] = ("retention_time", "retention_index")
    score_columns: tuple[str, ...] = ()
    preselection: int = 2000
    filter_on_ion_mode: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "metadata_columns", tuple(c.lower() for c in self.metadata_columns))
        if self.filter_on_ion_mode is not None and self.filter_on_ion_mode not in ION_MODES:
            raise ValueError(f"ion mode must be one of {ION_MODES}: {self.filter_on_ion_mode!r}")


@dataclass(frozen=True)
class TrainingSettings:
    """Fractions are divisors: 30 holds out one of 30. The defaults are the published training settings."""

    epochs: int = 150
    embedding_dim: int = 400
    base_dims: tuple[int, ...] = (500, 500)
    mz_min: float = 10.0
    mz_max: float = 1000.0
    mz_bin_width: float = 0.1
    intensity_scaling: float = 0.5
    fraction_validation_structures: int = 30
    fraction_validation_rows: int = 10
    n_trees: int = 250
    max_depth: int = 5
    min_leaf: int = 50
    candidates_per_query: int = 100
    seed: int = 42

    @classmethod
    def of(cls, **given) -> TrainingSettings:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown training settings: {sorted(unknown)}")
        return cls(**given)
