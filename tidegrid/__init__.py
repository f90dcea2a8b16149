"""Order-flow analytics on Spark: density grids, bars and the readouts over them, as DataFrame operations."""
