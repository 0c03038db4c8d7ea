"""Relational operators over notes: saved views, chunks, search, index maintenance, mutations."""
