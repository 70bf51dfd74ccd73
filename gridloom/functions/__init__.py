"""Array functions that work on bytes: bit packing, prefix codes, runs, byte planes and the container built from them."""
