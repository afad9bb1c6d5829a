"""Training and prediction from end to end."""
