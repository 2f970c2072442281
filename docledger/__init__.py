"""docledger: recognised business documents to reviewable ledger entries, as Spark DataFrame operators."""
