"""Tessera: a PySpark-native engine for preparing instruction-tuning and pre-training corpora."""
