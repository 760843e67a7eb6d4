"""DataFrame operators: analytics, matching, sequences, consensus, rules, evaluation and jobs."""
