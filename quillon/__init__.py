"""quillon: analytics over records, embedding vectors and a property graph, as plain PySpark.

Every operator is a function from DataFrames (and keyword parameters) to a
DataFrame.  Nothing here reads a file unless it lives in ``sources``.
"""

__version__ = "0.1.0"
