"""tidemark: versioned tables and metric series as plain Spark DataFrame jobs.

A versioned table is an append-only change table (partitioned by commit) plus a
small commit log.  Every read, diff, merge and rollup is a DataFrame plan over
those change rows, so Catalyst prunes partitions, pushes filters and picks the
join strategy.
"""

from tidemark.ledger import Ledger, Transaction
from tidemark.session import build_session, checkpoint_root

__all__ = ["Ledger", "Transaction", "build_session", "checkpoint_root"]
