"""Evidence processing for policy documents on the Spark DataFrame API."""

__version__ = "0.1.0"
