"""Registered queries: canonical tables in, operator results out."""

from tieout.plans import analysis, bridge, cells, commentary, hierarchy, logs, matching, quality, recon, scalars  # noqa: F401
from tieout.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
