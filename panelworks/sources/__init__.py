"""Reading and writing panels, risk tables and logs."""
