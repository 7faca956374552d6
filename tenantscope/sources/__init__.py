"""Sources (control tables, snapshots, text feeds) and sinks."""
