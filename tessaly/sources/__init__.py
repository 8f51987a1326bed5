"""Records as lines of JSON: sources in file order, strict and keyed ones, id lists, templates, and sinks."""
