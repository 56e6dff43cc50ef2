"""Training-data operators. Nothing else in gable imports this subpackage."""
