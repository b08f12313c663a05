"""A Spark-native engine for civic records: members, bills, divisions, votes and calendars."""
