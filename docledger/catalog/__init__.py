"""All registered queries and their SQL twins."""

from docledger.catalog import checks, inputs, learning, office, outputs, storage, text  # noqa: F401
from docledger.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
