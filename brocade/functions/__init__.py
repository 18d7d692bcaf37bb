"""Column expressions: success logic, texts, geometry, digests."""
