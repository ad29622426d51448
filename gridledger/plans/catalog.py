"""All registered queries."""

from gridledger.plans import (  # noqa: F401
    cases, control_tower, documents, files, settlement, streams, telemetry, workflow,
)
from gridledger.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
