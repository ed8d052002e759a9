"""Settings of the evidence pipeline, with two presets."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    k: int = 20
    expand: int | None = None  # vectors searched before documents are told apart; none: 20 k
    m: int = 10
    image_weight: float = 0.3
    rerank_weight: float = 0.7
    softmax_temperature: float = 1.0
    sigmoid_temperature: float = 1.0
    description_weight: float = 0.7
    confidence_threshold: float = 0.5
    max_cluster_size: int = 3
    target_size: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    clamp_weights: bool = True
    lambda_score: float = 0.7
    hybrid_lambda: float = 0.5
    e_min: float = 0.5
    margin: float = 0.15
    tau: float = 0.25
    edge_rule: str = "avg"
    dir_margin: float = 0.0
    strength_columns: tuple[str, ...] = ("combined_score", "rerank_norm", "similarity")

    @property
    def search_width(self) -> int:
        return self.expand or 20 * self.k


PRESETS = {
    "defaults": Settings(),
    "shipped": Settings(expand=20, image_weight=0.7, rerank_weight=0.3, hybrid_lambda=1.0, e_min=0.1, margin=0.1, tau=0.1),
}


def settings(preset: str = "defaults", **changes) -> Settings:
    """A preset with changes; names that are no setting are told and left out."""
    known = {f.name for f in fields(Settings)}
    for name in set(changes) - known:
        warnings.warn(f"no setting {name}", stacklevel=2)
    return replace(PRESETS[preset], **{k: v for k, v in changes.items() if k in known})
