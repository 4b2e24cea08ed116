"""Search, tagging and upkeep of large collections of study records, as PySpark DataFrame operators."""
