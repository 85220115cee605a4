"""Spark-native analytics for metered trips: conform, clean, rate zones, model tips, segment."""
