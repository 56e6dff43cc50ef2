"""gable: listing-price analytics and corpus preparation as Spark DataFrame functions."""
