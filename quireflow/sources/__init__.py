"""Readers and writers of documents, records, lexicons and reports."""

from . import readers, writers

__all__ = ["readers", "writers"]
