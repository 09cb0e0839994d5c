"""quaymark: Spark-native ingestion and reconciliation of retail extract files."""

__version__ = "0.1.0"
