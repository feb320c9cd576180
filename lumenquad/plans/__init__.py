"""Whole plans: cells to reports."""
