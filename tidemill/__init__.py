"""Web-corpus analytics as DataFrame operators."""
