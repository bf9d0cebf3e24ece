"""Clinical cohorts, time-binned features and fairness audits as Spark DataFrame functions."""
