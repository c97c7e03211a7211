"""pairlab.sources."""
