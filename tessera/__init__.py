"""tessera: hybrid retrieval and retrieval evaluation on Spark DataFrames."""

__version__ = "0.1.0"
