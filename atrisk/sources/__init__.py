"""Readers of landed registries and derivations from the driver's tables."""
