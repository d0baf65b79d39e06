"""Queries over the driver's star-schema tables and the SQL they must equal."""
