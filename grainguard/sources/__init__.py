"""Readers and writers: the test tables, catalogs, the validation history and its exports."""
