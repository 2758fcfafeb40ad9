"""Part of the text-analytics engine."""
