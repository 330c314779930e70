"""Whole plans: retrieval and question understanding."""
