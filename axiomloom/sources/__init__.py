"""Readers and writers: tables of terms, RDF documents."""
