"""Analytics for sports archives on Spark."""
