"""Column functions of the note text model."""
