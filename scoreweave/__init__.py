"""Spark-native analytics for grading open-question exams in bulk."""
