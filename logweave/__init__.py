"""logweave: log analytics and incident engine on Spark DataFrames."""
