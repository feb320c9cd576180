"""PySpark-native scoring and data-processing engine for paired question-answering benchmarks."""
