"""Logs, state tables, snapshots and fixtures: what is read and written."""
