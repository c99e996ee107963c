"""marklake: a Spark-native engine for collections of Markdown-style documents."""

__version__ = "0.1.0"
