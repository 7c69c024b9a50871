"""PySpark-native raster encoding: row prediction filters, chunk planning, mergeable checksums and PNG framing."""

__version__ = "0.1.0"
