"""Nodes of pipelines; importing the package registers them."""

from . import columns, relations  # noqa: F401
from .base import NODES, AnalysisError, Inputs, Output, node, types

__all__ = ["NODES", "AnalysisError", "Inputs", "Output", "node", "types"]
