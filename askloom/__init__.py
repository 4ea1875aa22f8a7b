"""Askloom: build, query and judge document question answering over whole tables with Spark."""

__version__ = "0.1.0"
