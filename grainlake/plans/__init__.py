"""plans of grainlake."""
