"""Readers of the project's file formats."""
