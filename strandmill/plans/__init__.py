"""FASTQ analytics on Spark DataFrames."""
