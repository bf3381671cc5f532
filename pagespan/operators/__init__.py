"""DataFrame operators: targets, runs, results, flow control, legacy import."""
