"""Plan helpers: size-checked broadcast, top-k by rank filter."""
