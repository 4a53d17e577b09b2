"""kgloom: a Spark-first engine that builds and queries knowledge graphs from claims and text."""

__version__ = "0.1.0"
