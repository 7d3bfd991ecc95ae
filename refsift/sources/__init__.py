"""Reading bibliographies, LaTeX files, records and captured responses."""
