"""marketlens: marketplace analytics reports as lazy Spark DataFrames.

Reports take a :class:`~marketlens.tables.Tables` bundle of the eight
marketplace tables and return DataFrames; nothing is collected by the library.
"""

from marketlens.tables import Tables

__all__ = ["Tables"]
