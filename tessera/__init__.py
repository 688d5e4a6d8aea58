"""tessera: retrieval analytics over DataFrames, at data-set scale."""

__version__ = "0.1.0"
