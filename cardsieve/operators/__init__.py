"""DataFrame to DataFrame steps: ingest, features, splits, statistics, profile, run logs."""
