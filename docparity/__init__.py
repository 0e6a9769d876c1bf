"""PySpark-native analytics over document extractions: parse, score, escalate, compare, validate, report."""
