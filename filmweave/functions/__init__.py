"""Column builders and the wikitext parser."""
