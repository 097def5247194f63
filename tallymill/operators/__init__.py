"""Ledger operators: pre-pass, fold, replay, events, state, reads, metrics, snapshots, graph."""
