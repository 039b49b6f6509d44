"""Every operator bound to the given tables, each beside the SQL that states its result.

``QUERIES`` and ``ORACLE`` are filled by the modules imported below.
"""

from grainguard.bindings.registry import ORACLE, QUERIES
from grainguard.bindings import conformance, governance, history, joins, sources, streams, synthesis, tables  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
