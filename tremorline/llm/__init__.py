"""Training-data operators: grouping, survivors, packing, mixing, shared spans. Nothing else imports this package."""
