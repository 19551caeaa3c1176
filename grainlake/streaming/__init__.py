"""streaming of grainlake."""
