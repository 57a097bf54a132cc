"""PySpark jobs for shortening, screening, scoring and comparing long texts."""
