"""Reading, writing, versioning and logging of tables."""
