"""API-contract analytics on Spark: catalogues of endpoints, types and examples as DataFrames."""
