"""Continuous form of the poll-and-merge job."""
