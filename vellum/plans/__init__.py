"""Registered queries. Importing this package's modules registers them."""
