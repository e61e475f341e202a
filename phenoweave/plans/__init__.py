"""Roles played by the test tables, the query registry and its SQL counterparts."""
