"""plumbline: a PySpark-native engine for architecture, graph and code-security analytics."""

__version__ = "0.1.0"
