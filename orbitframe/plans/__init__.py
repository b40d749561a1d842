"""Validated parameters and the predicates made from them."""
