"""All queries. Importing the modules fills the registry."""

from stackloom.plans import q_labels, q_metrics, q_probes, q_samples, q_sources, q_stacks  # noqa: F401
from stackloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
