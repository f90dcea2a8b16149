"""Where records come from: adapters of tables, synthetic markets, and the recorded store."""
