"""Organisational graph analytics as PySpark DataFrame operators."""

from orgweft.session import durable, session

__all__ = ["durable", "session"]
