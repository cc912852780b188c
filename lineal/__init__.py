"""Genealogical analytics on Spark: haplotypes, intervals and genealogies as DataFrames."""
