"""Fluent rules: values that only describe until a terminal builds and returns a DataFrame."""
