"""Spark-native segmentation, audit and reconciliation of paginated corpora."""
