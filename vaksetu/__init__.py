"""Text-corpus analytics on Spark: every operator is a Column builder or a DataFrame transform."""

__version__ = "0.1.0"
