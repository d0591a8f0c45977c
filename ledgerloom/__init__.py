"""Record linkage and analytics on Spark: matching purchase documents to a card ledger."""
