"""Reading tables and labelled records, writing results."""
