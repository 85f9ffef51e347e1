"""Maps, samples and images from tables."""
