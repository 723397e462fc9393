"""Moves tables between systems on Spark and proves that they arrived intact."""
