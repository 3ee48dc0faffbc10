"""Sources and sinks: matrices, raster stacks, train/test store, result documents."""
