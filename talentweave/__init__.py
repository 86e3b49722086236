"""Bulk matching of people to open positions as lazy Spark DataFrame operators."""
