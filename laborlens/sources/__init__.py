"""Tables of the labour market as DataFrames over Parquet."""
