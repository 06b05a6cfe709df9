"""Domain views over the test tables, and stage composition."""
