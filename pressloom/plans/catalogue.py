"""All queries of the curation package."""

from __future__ import annotations

from pressloom.plans import curation, gates, stories, streaming, telemetry  # noqa: F401
from pressloom.plans.registry import ORACLES, QUERIES  # noqa: F401
