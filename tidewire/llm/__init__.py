"""Training-data operators. Nothing outside this subpackage imports it, but for the guarded hook of the driver's entry file."""
