"""Readers and writers for the landed file formats.

Fetching files and decoding NetCDF, Excel and tar are landing steps outside the
library. Readers take a file, a directory or a list of paths, and always an
explicit schema, so nothing is inferred from the data.
"""
