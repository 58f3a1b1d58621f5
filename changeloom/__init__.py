"""Change-data analytics on Spark: transactions, versions, schemas and routing as DataFrame operators."""
