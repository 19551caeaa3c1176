"""functions of grainlake."""
