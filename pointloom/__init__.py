"""Spark-native analytics for labelled 3-D point scenes and the experiment tables derived from them."""

__version__ = "0.1.0"
