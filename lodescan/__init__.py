"""lodescan: website discoverability analytics over tables of crawled pages."""

__version__ = "0.1.0"
