"""Column-level helpers: tolerant casts, value shapes and digests."""
