"""larkspur: a declarative analytics engine on PySpark DataFrames."""
