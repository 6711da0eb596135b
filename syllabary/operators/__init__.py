"""Generic relational operators over any entity graph."""
