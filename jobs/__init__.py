"""Jobs that run from the command line over the library's operators. Nothing here imports the training-data operators."""
