"""Spark-native analytics over catalogs of repeated acquisitions and the raster series behind them."""
