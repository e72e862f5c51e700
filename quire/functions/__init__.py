"""Column functions and the byte-level kernels behind them."""
