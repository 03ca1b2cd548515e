"""Every registered query, section by section, each with its DuckDB twin where SQL can say it."""

from cadenza.plans import catalogue, analytics, sound, retrieval, learning  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES  # noqa: F401
