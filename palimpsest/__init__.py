"""palimpsest: a Spark-first analytics engine over layered, versioned text and event memory."""

__version__ = "0.1.0"
