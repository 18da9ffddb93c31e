"""folioscope: a Spark-native engine for scientific-document retrieval, evaluation and corpus preparation."""

__version__ = "0.1.0"
