"""Staging, dimensions, facts, reports, alerts and history as DataFrame plans."""
