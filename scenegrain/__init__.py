"""Index-first analytics for tiled raster archives on Spark."""

__version__ = "0.1.0"
