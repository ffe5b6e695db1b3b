"""Analytical operators; every one maps DataFrames to a DataFrame."""
