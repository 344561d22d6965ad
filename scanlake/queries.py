"""All registered queries."""

from scanlake.plans import annotations, assembly, evaluation, files, images, modelling, names, splitting  # noqa: F401
from scanlake.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
