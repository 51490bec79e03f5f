"""Price-bar analytics on PySpark: ingest, features, market regimes and their evaluation as DataFrame plans."""
