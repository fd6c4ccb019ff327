"""Vellum: a PySpark-native engine for analysing scanned and digital documents."""
