"""Operators: DataFrame -> DataFrame building blocks of the analysis."""
