"""Column functions: text cleaning, nested marking, JSON values, display formats, files."""
