"""Writers of verdicts, span texts and simulation files."""
