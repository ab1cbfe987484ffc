"""Training-data operators: ten stand-alone operators over documents and conversations, and their queries."""
