"""The registered queries; importing the modules registers them."""

from ..registry import ORACLE, QUERIES
from . import knowledge, retrieval, shells, sources, text, usage

__all__ = ["ORACLE", "QUERIES", "knowledge", "retrieval", "shells", "sources", "text", "usage"]
