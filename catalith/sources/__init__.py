"""Readers and writers of tables, journals, archives and segment files."""
