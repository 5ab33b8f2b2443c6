"""recolith: a Spark engine for reconciling record libraries.

Every operator takes DataFrames and returns a DataFrame. Sub-packages:
``functions`` (column expressions), ``operators`` (relational operators),
``sources`` (readers and writers), ``streaming`` (Structured Streaming
versions), ``plans`` (registered queries with their SQL oracles).
"""

__version__ = "0.1.0"
