"""Ways of running order statistics, running totals and ordered fills without a one-task window."""
