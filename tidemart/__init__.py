"""Warehouse jobs for an online shop as Spark DataFrame functions, for batch tables and streams."""
