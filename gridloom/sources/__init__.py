"""Containers in files as a data source."""
