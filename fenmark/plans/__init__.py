"""Whole plans: reports, the screening study and its command line."""
