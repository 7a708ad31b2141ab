"""sigloom: a PySpark-native analytics engine for sampled signals and event tables."""

__version__ = "0.1.0"
