"""Spark-native operators for edit histories, page texts, link graphs and curated records."""
