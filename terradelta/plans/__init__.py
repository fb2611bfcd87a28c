"""Parameters of the analyses and the predicates made of them."""
