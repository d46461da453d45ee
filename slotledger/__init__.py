"""Probabilistic forecast ledger as Spark jobs: issue, record and judge interval forecasts."""

from slotledger.config import LedgerConfig, ModelSpec, NAIVE_SPECS, REFERENCE_MODEL

__all__ = ["LedgerConfig", "ModelSpec", "NAIVE_SPECS", "REFERENCE_MODEL"]
