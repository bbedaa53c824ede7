"""Reading and writing: parquet tables, folders of files, Word documents, profiles, and the constant template."""
