"""Readers and sinks for survey files, scene catalogs, gage tables and grids."""
