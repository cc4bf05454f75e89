"""Topic tables, the assembled panel, analysis samples and model runs."""
