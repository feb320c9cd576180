"""Column functions: answer extraction, statistics, sampling, cost."""
