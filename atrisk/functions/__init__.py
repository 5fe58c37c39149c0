"""Column builders: text keys, coordinates, geometry, valuation."""
