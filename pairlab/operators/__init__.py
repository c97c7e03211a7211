"""pairlab.operators."""
