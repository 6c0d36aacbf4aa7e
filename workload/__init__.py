"""The registered queries: planted inputs, Spark plans, and the SQL they must agree with."""
