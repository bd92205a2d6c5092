"""Document analytics on Spark: schemaless collections, filters, aggregation, change feed."""

__version__ = "0.1.0"
