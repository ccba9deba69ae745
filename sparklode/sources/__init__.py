"""Readers, writers and scratch tables."""

from sparklode.sources.tables import load

__all__ = ["load"]
