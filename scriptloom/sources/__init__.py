"""Readers and writers: typed tables, script files, CSV exports."""
