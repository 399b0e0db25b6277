"""Spark-native analytics over gridded motion fields: cells, fused maps, events and region tubes."""
