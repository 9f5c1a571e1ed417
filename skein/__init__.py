"""Spark-first analytics over call traces, latency experiments and corpora."""
