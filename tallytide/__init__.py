"""Calendar-anchored count reports over large event tables, as Spark DataFrame operations."""
