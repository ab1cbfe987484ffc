"""DataFrame operators over facts, sentences and reviews."""
