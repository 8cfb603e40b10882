"""tickwise: market-bar analytics (indicators, signals, rebalancing, ML prep) on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, window functions and aggregations, so the same definitions run
in batch and inside Structured Streaming ``foreachBatch`` / stateful operators.
"""

__version__ = "0.1.0"
