"""Roles of callers."""

from __future__ import annotations

# Roles by rank.
ROLES = ("viewer", "editor", "admin")


def allowed(role: str, needed: str) -> bool:
    """Whether a role has at least the rank of another; an unknown one has none."""
    return role in ROLES and ROLES.index(role) >= ROLES.index(needed)
