"""SQLite-flavoured SQL on Spark: a parser, and a type-aware writer of Spark SQL."""

from tessera.dialect.engine import Dialect, translate

__all__ = ["Dialect", "translate"]
