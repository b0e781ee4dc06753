"""Text operators for training data: packing, mixing and splitting. Nothing outside this package imports it."""
