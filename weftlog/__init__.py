"""weftlog: pipelined log analytics on PySpark."""
