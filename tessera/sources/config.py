"""Mixture configurations (O09): the one top key names the mixture; a subset inherits what its parent says."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Mixture:
    name: str
    parts: list[dict[str, Any]] = field(default_factory=list)
    proportions: dict[str, float] = field(default_factory=dict)
    embedding_model: str | None = None


def load_mixture(source: str | dict) -> Mixture:
    if isinstance(source, str):
        import yaml

        source = yaml.safe_load(source)
    if len(source) != 1:
        raise ValueError("a mixture has one top key, its name")
    (name, body), = source.items()
    parts = [p for d in body.get("data", []) for p in expand(d)]
    return Mixture(name, parts, dict(body.get("final_setfit_proportions") or {}), body.get("chromadb_embedding_model"))


def expand(part: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """The part, or each of its subsets over it; a limit may go by either of its two keys."""
    parent = {k: v for k, v in part.items() if k != "subsets"}
    for subset in part.get("subsets") or [{}]:
        one = {**parent, **subset}
        if "setfit_limit" in one:
            one.setdefault("setfit_limits", one.pop("setfit_limit"))
        yield one
