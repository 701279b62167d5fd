"""Readers of files and images. Importing the package registers every decoder."""

from quarrybed.sources import eventlogs, extfs, hives  # noqa: F401
