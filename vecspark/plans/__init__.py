"""Logical pieces that become Catalyst plans: payload filters."""
