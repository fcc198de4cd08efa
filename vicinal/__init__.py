"""Neighbourhood analytics on vector tables, expressed as Spark plans."""

__version__ = "0.1.0"
