"""Column functions: longitudes, projections, calendars, text forms."""
