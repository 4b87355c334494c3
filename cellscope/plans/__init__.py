"""Query plans: the registered queries, their SQL oracle and the jobs."""
