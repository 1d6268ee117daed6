"""Row rules on streams: the batch predicates, applied to an unbounded table."""
