"""Registered queries: importing this package fills ``QUERIES``/``ORACLE``."""

from . import filters, questions, reports, sources  # noqa: F401  (registers on import)
from . import streams  # noqa: F401,E402  (uses the oracles registered above)
from .registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES", "register"]
