"""DataFrame-to-DataFrame operators over tables of requests."""
