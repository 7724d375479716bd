"""DataFrame operators over the row form."""
