"""Rasterquarry: image containers, pixel planes and training text as Spark tables."""
