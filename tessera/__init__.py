"""Tessera: a Spark-native analytics engine for star- and snowflake-schema workloads."""

from tessera.session import get_session

__all__ = ["get_session"]
