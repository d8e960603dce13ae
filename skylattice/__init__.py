"""skylattice: sky catalogues and observation metadata as Spark DataFrames.

Functions take and return ``Column``; operators, sources and plans take and
return ``DataFrame``.  Nothing here collects data to the driver unless its
size is bounded by the arguments.
"""

__version__ = "0.1.0"
