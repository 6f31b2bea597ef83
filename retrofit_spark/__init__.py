"""Spark-native analytics over building energy certificates and heat-pump uptake."""
