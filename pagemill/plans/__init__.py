"""The catalogue of registered queries over the driver's tables."""
