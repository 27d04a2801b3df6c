"""Training-data operators: quality rules, near-dedup, exact substring dedup,
sharding, mixing, packing, top-k search, page extraction, licence scans and
chat formatting.  Nothing outside this subpackage imports it."""
