"""MLlib training, scoring, metrics and attribution."""
