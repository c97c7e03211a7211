"""pairlab.plans."""
