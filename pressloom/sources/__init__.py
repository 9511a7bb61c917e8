"""Tables of the curation model: schemas, readers and adapters."""
