"""lexquarry: a Spark-first engine for finding, linking and classifying references in document collections."""

__version__ = "0.1.0"
