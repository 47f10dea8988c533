"""Drayline: Spark-native data migration, cleaning and entity resolution."""
