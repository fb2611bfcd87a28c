"""Readers and writers of the region packages."""
