"""Every operator as a query on the given tables, with the same answer stated in SQL."""

from workload.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
