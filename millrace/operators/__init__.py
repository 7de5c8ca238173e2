"""Preprocessing, splitting, metrics and models."""
