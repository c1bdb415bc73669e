"""Foliary: Spark DataFrame operators for large document collections."""
