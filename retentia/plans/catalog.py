"""All registered queries (importing the catalog modules fills the registry)."""

from __future__ import annotations

from retentia.plans import catalog_features  # noqa: F401
from retentia.plans import catalog_segments  # noqa: F401
from retentia.plans import catalog_experiment  # noqa: F401
from retentia.plans import catalog_evaluate  # noqa: F401
from retentia.plans import catalog_model  # noqa: F401
from retentia.plans import catalog_sinks  # noqa: F401
from retentia.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
