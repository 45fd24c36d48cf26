"""Sources, input checks, sinks and the boundaries to outside libraries."""
