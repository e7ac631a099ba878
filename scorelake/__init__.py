"""Scorelake: corpus-scale analysis of symbolic music on PySpark DataFrames."""
