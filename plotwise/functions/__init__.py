"""Part of the location-analytics engine."""
