"""Queries registered with the driver, each beside the SQL that checks it."""
