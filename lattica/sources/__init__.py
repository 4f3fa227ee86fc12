"""Tables: plain Parquet, the versioned store, and the catalog that describes them."""
