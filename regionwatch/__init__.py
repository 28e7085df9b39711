"""regionwatch: early-warning analytics on daily per-region signal panels, on Spark."""
