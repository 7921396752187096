"""Jobs with a command line: each reads tables by plain paths and writes partitioned output, all through Spark."""
