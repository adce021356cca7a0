"""A payment-ledger analytics engine on Spark."""
