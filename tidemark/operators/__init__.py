"""DataFrame operators.  Each takes DataFrames (and small metadata) and returns
a DataFrame plan; none of them collects table data to the driver."""
