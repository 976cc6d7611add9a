"""newsfold: news-event analytics as PySpark DataFrame transformations."""
