"""A PySpark engine that turns collections of free-text notes into typed, linked, queryable mentions."""
