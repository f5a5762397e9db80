"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""
