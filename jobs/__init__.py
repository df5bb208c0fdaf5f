"""Jobs that run from a command line and a config file."""
