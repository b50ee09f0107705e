"""The evidence report: operators put together into scored findings."""
