"""DataFrame → DataFrame operators of the segmentation workload."""
