"""rollcall: a DataFrame-first engine for positioned text, record linkage and corpus work."""
