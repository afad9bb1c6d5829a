"""One query per operator over the given tables, with the equivalent SQL where there is one."""

from titlekit.queries import knn, lists, model, reports, sources, text  # noqa: F401
from titlekit.queries.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
