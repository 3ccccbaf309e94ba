"""DataFrame -> DataFrame operators (features, quality, profile, split, metrics, models)."""
