"""Column functions: opaque JSON values, proto3 scalars, JSON and YAML text."""
