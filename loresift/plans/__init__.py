"""Where an index lives: derived from documents on the fly, or stored as tables."""
