"""Data operators over survey, response, mapping and result tables."""
