"""Reading records and chunks, writing shards, chunks and manifests."""
