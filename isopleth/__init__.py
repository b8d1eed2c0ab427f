"""isopleth: climate and environmental analytics as Spark DataFrame jobs.

The library is a set of functions that take and return DataFrames (or Columns).
Nothing here runs a wall clock: "today" is always a parameter.
"""

__version__ = "0.1.0"
