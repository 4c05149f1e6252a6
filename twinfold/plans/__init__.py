"""The engine, its command line, and the catalogue of queries."""
