"""PySpark-native analytics for timestamped, interval-based and ranked data."""
