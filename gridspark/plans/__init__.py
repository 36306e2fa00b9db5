"""Whole workflows as plans: audit, compare and answer."""
