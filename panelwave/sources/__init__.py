"""Reading wide survey tables and the panels derived from the test tables."""
