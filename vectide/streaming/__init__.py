"""Models that are kept up to date over streams."""
