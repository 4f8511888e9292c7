"""Sluice: table dataflows for PySpark."""

__version__ = "0.1.0"
