"""Spark-native analytics over term co-occurrence networks and article feeds."""
