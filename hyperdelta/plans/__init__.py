"""What is decided before a query runs: schemas, their order, versions, and schemas that are data."""
