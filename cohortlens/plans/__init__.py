"""Composite plans: the segmentation run and the registry of named queries."""
