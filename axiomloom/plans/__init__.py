"""How queries are run: checkpoints, build targets and the command line."""
