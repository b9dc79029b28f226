"""Every registered query by name, and the SQL that states the same."""

from . import corpus, evaluation, files, flows, language, prepared, training  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
