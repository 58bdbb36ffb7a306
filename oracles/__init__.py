"""DuckDB statements with the expected result of every registered query."""

from oracles.statements import ORACLES

__all__ = ["ORACLES"]
