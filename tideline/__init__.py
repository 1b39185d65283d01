"""Realtime-warehouse operators as plain PySpark DataFrame functions."""
