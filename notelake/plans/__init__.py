"""Driver-side retrieval plans."""
