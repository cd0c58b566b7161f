"""partloom: parts-catalogue equivalence and retail analytics on Spark."""
