"""Dataset registry, readers and storage access."""
