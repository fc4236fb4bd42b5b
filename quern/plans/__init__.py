"""Registered queries: name -> callable(spark, sf_dir), with the SQL that states the same result."""

from . import base, documents, messages, scores, tokens  # noqa: F401


def queries() -> dict:
    return dict(base._QUERIES)


def oracle_sql() -> dict:
    return dict(base._SQL)
