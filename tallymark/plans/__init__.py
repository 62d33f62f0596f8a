"""Query plans over the given tables and their SQL counterparts.

Importing a module of this package registers its queries.
"""

from . import accuracy_plans, answer_plans, arithmetic_plans, file_plans, log_plans, text_plans  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
