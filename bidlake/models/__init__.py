"""MLlib training, model persistence and batch scoring."""
