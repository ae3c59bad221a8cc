"""Where rows come from: tables, packed bar files, journals, provider documents."""
