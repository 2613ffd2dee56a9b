"""Spark DataFrame operators for studying how news moves prices."""

from tidemark.session import build_session, configure

__all__ = ["build_session", "configure"]
