"""Web-page risk analytics and page-corpus processing, written for Spark."""

__version__ = "0.1.0"
