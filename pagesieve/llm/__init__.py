"""Operators for preparing training text from crawled pages.

Nothing outside this package imports it.
"""
