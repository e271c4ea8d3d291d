"""Ostinato: event and signal analytics expressed as Spark DataFrame programs."""
