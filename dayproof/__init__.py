"""Day-by-day evidence reconciliation of an event log and its derived tables, on Spark."""

from dayproof.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
