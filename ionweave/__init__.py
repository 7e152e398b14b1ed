"""Spark-native analytics for spatial mass spectrometry, as lazy DataFrame operators."""
