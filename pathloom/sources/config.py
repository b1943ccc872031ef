"""Settings, with the defaults of the published configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    seed: int = 42
    hidden_dim: int = 64
    dropout: float = 0.3
    mc_samples: int = 20
    learning_rate: float = 1e-3
    epochs: int = 50
    batch_size: int = 128
    t_base: float = 60.0
    t_penalty: float = 300.0
    lambda_risk: float = 0.5
    num_targets: int = 10
    min_depth: int = 1
    subgraph_size: int = 50


def load(path: str) -> Config:
    """Read a YAML file of nested sections; keys that Config doesn't know are left alone."""
    import yaml

    with open(path, encoding="utf-8") as f:
        said = yaml.safe_load(f) or {}
    flat = dict(said)
    for section in said.values():
        if isinstance(section, dict):
            flat |= section
    names = {"lr": "learning_rate"}
    known = {f.name for f in fields(Config)}
    return Config(**{names.get(k, k): v for k, v in flat.items() if names.get(k, k) in known})
