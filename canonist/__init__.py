"""PySpark jobs for versioned, hierarchical documents in bulk."""
