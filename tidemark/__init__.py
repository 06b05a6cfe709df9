"""Evidence-driven lead analytics on Spark."""
