"""Part of seriesloom."""
