"""longweave: Spark-native analytics over long reads and other ordered, labelled segments."""

__version__ = "0.1.0"
