"""auditlake: a Spark-native engine that audits what software agents did."""

__version__ = "0.1.0"
