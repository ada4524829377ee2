"""End-to-end plans made of the operators."""
