"""Row-wise operators on unbounded tables."""
