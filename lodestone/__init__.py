"""Lodestone: a Spark-native analytics engine for corpora of notes, source code and training text."""
