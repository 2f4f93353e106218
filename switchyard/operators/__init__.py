"""DataFrame operators of the routing data model."""
