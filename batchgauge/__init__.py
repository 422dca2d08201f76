"""Spark-native quality engine for batches of sensor readings.

Every operator takes DataFrames and plain parameters and returns a DataFrame.
"""
