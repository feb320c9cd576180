"""Incremental runs: resume, checkpoints, stateful simulations."""
