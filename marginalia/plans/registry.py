"""All registered queries and their oracles."""

from __future__ import annotations

from marginalia.plans import catalogue, classes, history, landed, reading, upkeep, vocabulary  # noqa: F401  they fill the tables below
from marginalia.plans.register import ORACLE_SQL, QUERIES  # noqa: F401
