"""Candidate-selection and structure analytics as Spark DataFrame transforms."""

from sievelark.session import make_session, settle

__all__ = ["make_session", "settle"]
