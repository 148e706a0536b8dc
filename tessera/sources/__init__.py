"""Readers and writers: landed tables, delimited files, manifests, resumable sinks."""
