"""Where rows come from: tables, files, datasets and snapshots."""
