"""Analytics over collections of files and documents, as DataFrame functions."""

__version__ = "0.1.0"
