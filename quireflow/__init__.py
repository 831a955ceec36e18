"""A PySpark-native engine for analysing long documents."""

__version__ = "0.1.0"
