"""Registered queries: each is a Spark plan over the driver tables plus the
equivalent DuckDB SQL used as the correctness oracle."""

from .registry import QUERIES, load_all  # noqa: F401
