"""Text operators for training data.  Imports the core; the core never imports this."""
