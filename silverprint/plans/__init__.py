"""Cleanup plans as tables: trash, rename, undo, albums and their checks."""
