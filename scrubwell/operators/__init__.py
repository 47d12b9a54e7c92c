"""Detection, cleaning and model-comparison operators."""
