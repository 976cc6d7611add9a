"""Queries over the driver tables: adapters, registry, SQL."""
