"""Nucleotide sequence search over single cells, as DataFrame plans on Spark."""
