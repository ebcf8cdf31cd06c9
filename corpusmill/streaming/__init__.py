"""Long-running forms: file backlogs, throughput windows, stateful counts, metric logs."""
