"""Readers of pages, ledgers, logs and directories, and the writers beside them."""
