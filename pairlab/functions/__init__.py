"""pairlab.functions."""
