"""Nothing streams: listings, manifests and history branches are bounded, and so is every computation over them."""
