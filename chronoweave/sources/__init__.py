"""Readers and writers of the library's tables and of the files that recorders and recognisers leave."""
