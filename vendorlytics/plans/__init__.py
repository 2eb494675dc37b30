"""Business datasets: sales mart, listings, shipping, P&L, sourcing, vendor
scorecard, and the batch jobs that write them."""
