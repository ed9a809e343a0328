"""Readers that turn directories, artifacts and records into DataFrames."""
