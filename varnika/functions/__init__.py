"""Column functions: text, character vocabularies and the rule transliterator."""
