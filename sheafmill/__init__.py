"""A document-dataflow engine on PySpark DataFrames."""
