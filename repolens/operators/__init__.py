"""Relational operators: DataFrame -> DataFrame functions that take column names as parameters."""
