"""Spark-native clause analytics: text cleaning, segmentation, windows, findings and their roll-up."""
