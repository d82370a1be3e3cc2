"""Readers and writers for molecule files."""
