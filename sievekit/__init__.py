"""Spark-native retrieval analytics: retrieve, fuse, gate, evaluate, calibrate, validate."""
