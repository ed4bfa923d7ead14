"""Queries and SQL of this folder, as the entry point adds them."""

from alertloom.llm import queries
from alertloom.llm.sql import ORACLE  # noqa: F401

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")}
