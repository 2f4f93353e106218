"""switchyard: a PySpark-native analytics engine for model-routing data.

Sub-packages
------------
functions   column expressions (normalisation, shingles, identifiers, prices)
sources     verified scans, loaders and sinks
operators   DataFrame -> DataFrame operators (canonical tables, validation,
            deduplication, splits, routing, metrics, replay)
plans       sessions, scratch tables and whole query plans with their SQL
streaming   Structured Streaming forms of the route log operators
"""

__version__ = "0.1.0"
