"""Cellarium: a PySpark-native engine that profiles, types and links messy tables."""
