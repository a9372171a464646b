"""Operators for preparing training text: filtering, de-duplication, packing, sharding."""
