"""DataFrame operators: joins, relations, profiles, write algebra, decoding, access."""
