"""Registered queries (Spark DataFrame plans) and their independent SQL oracles."""
