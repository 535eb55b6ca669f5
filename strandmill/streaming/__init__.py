"""Structured Streaming over folders of FASTQ files and over tables of reads."""
