"""End-to-end plans built of the operators."""
