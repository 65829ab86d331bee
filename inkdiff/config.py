"""Tunable parameters of the comparison."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, fields

PREFIX = "INKDIFF_"


@dataclass(frozen=True)
class Config:
    number_weight: float = 0.20
    heading_weight: float = 0.30
    embedding_weight: float = 0.50
    accept_threshold: float = 0.50
    review_threshold: float = 0.35
    min_clause_length: int = 20
    max_terms: int = 5000
    summary_timeout: int = 10
    embedding_model: str = ""
    #: Documented behaviour that the default does not follow: any signal, conditions included, is substantive.
    conditions_are_substantive: bool = False

    def __post_init__(self) -> None:
        if abs(self.number_weight + self.heading_weight + self.embedding_weight - 1) > 1e-9:
            warnings.warn("the three weights do not sum to 1", stacklevel=2)


def load_config(environment: dict[str, str] | None = None) -> Config:
    """Defaults, overridden by INKDIFF_<FIELD> variables."""
    env = os.environ if environment is None else environment
    kinds = {"float": float, "int": int, "str": str, "bool": lambda x: x.lower() in ("1", "true", "yes")}
    return Config(**{f.name: kinds[f.type](env[PREFIX + f.name.upper()]) for f in fields(Config) if PREFIX + f.name.upper() in env})
