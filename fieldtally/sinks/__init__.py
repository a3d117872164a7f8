"""Sinks: where records go, as foreachBatch functions."""
