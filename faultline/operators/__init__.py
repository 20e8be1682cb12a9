"""DataFrame operators of the log-to-incident flow."""
