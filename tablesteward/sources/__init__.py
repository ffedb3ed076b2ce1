"""Reading and writing: tables, Parquet footers, snapshots, evaluation sets."""
