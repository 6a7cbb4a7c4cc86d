"""Readers and writers for raster, vector and label files."""
