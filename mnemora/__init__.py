"""mnemora: a PySpark-native engine for long-lived knowledge stores.

Documents, embedding vectors, dated graphs and interaction logs are DataFrames; every
capability is a function from DataFrames (and parameters) to a DataFrame.
"""

__version__ = "0.1.0"
