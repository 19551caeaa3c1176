"""sources of grainlake."""
