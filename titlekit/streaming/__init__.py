"""Prediction on streams."""
