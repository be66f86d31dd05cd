"""Marketplace order analytics on PySpark: raw text tables to a star schema to reports."""
