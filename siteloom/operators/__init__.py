"""Operators over tables of crawled pages, their links, audits and texts."""
