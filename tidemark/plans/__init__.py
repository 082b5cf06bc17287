"""Logical planning helpers: table schemas with field ids, commit lineage,
and the registered query catalog."""
