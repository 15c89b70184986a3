"""A Spark engine for versioned regulatory document corpora."""
