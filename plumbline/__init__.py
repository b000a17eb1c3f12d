"""plumbline: a Spark-native engine that judges whether a dataset is fit to train or test a model."""

__version__ = "0.1.0"
