"""tracewright: forensic analytics over append-only activity logs, on Spark SQL."""

__version__ = "0.1.0"
