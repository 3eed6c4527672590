"""Spark jobs for checking interval and hourly price feeds and releasing forecast models."""
