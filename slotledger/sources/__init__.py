"""Landed feeds in, ledger tables and exports out."""
