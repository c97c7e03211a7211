"""pairlab.streaming."""
