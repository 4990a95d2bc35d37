"""End-to-end plans: feature extraction, training, scoring and reporting."""
