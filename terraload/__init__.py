"""Geographic table ingest and analysis on Spark DataFrames."""
