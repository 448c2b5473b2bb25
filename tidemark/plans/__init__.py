"""Whole analyses: the route of each area, and the tables that users export."""
