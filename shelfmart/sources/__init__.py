"""Reads of the shop tables and the landed marketplace documents."""
