"""Operators for large training-data pipelines.  Nothing outside this
subpackage (but the driver contract at the repository top) imports it."""
