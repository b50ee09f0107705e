"""Reading, row ids, versions, exports and sample data."""
