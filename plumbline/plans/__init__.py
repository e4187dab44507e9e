"""Plans that share scans between operators."""
