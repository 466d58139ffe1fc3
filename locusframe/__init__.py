"""Genome perturbation and contact-map analytics on Spark DataFrames."""
