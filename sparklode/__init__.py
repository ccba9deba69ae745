"""sparklode: analytics over text-and-activity tables, written as Spark DataFrame jobs."""
