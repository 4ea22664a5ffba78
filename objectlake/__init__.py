"""Schemaless, content-addressed objects as Spark tables, and the questions one asks of them."""
