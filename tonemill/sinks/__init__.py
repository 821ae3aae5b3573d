"""Writers for splits, predictions, matrices, reports, manifests and models."""
