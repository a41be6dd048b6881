"""Scoring of arriving intervals with fitted parameters."""
