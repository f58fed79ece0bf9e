"""tallymark: document reconciliation on Spark, as composable DataFrame operators."""
