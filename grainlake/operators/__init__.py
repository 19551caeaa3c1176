"""operators of grainlake."""
