"""Whole plans composed of operators, and the registry of queries."""
