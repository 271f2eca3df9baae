"""Training-data operators over `documents` and `pages`; nothing else in the library imports this subpackage."""
