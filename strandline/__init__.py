"""Timeline analytics on PySpark: ranges, sampling grids, tiles, manifests and triage."""
